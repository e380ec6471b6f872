"""A stored table of row windows that is kept up with new, late and corrected days.

The table holds the panel and its window columns by year, with the number of rows of every
division and year beside it. A batch changes the windows of its own rows and of the rows after
them whose frames reach back to one: the next ``REACH`` rows of the division, however many
days or years these span. The counts tell which years hold those rows and the ``REACH`` rows
before them, which the frames need. Only these years are read, only divisions of the batch go
through the windows, and only years with a changed row are written again.

A year is one batch of a commit (``sources.committed``): all years that an update rewrites
move to the new attempt in one step, readers see the table before or after it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrorisk.operators.spi import WINDOWS, transform_spi
from hydrorisk.operators.windows import antecedent_rain, over_rows, rolling_sums
from hydrorisk.schemas import DATE, DIVISION, KEY, MEASURES
from hydrorisk.session import settle
from hydrorisk.sources.committed import commit, current_commits

TASK = "features"
TABLE, COUNTS = "features", "counts"
# Rows before its own that the longest frame of a row spans.
REACH = max(WINDOWS) - 1
SUMS = {n: f"rain_rolling_{n}d" for n in WINDOWS}
WINDOW_COLUMNS = ["rain_lag_1", "rain_rolling_3d", "rain_rolling_7d", *SUMS.values()]

_YEAR = T.StructField("year", T.IntegerType())
_ATTEMPT = T.StructField("attempt", T.StringType())


def _panel_schema(measures: list[str]) -> T.StructType:
    fields = [T.StructField(DATE, T.DateType()), T.StructField(DIVISION, T.StringType())]
    return T.StructType([*fields, *[T.StructField(c, T.DoubleType()) for c in measures]])


class FeatureStore:
    """The table under ``path``; ``measures`` are the panel's columns besides day and division."""

    def __init__(self, spark: SparkSession, path: str, measures: list[str] = MEASURES):
        self.spark, self.path, self.measures = spark, path, measures
        self._panel = _panel_schema(measures)
        windows = [T.StructField(c, T.DoubleType()) for c in WINDOW_COLUMNS]
        self.schema = T.StructType([*self._panel.fields, *windows])
        self._counts = T.StructType([T.StructField(DIVISION, T.StringType()), T.StructField("rows", T.LongType())])

    def _listed(self, years: Iterable[int] | None = None) -> list[tuple[str, str]]:
        """Attempt and year of the stored years, or of those among ``years``."""
        listed = current_commits(self.spark, self.path, TASK).select("batch", "attempt").collect()
        wanted = None if years is None else set(years)
        return [(r["attempt"], r["batch"]) for r in listed if wanted is None or int(r["batch"]) in wanted]

    def _read(self, table: str, schema: T.StructType, years: Iterable[int] | None = None) -> DataFrame:
        """Rows of some years, or all, with ``year``; only the folders of these years are read."""
        root = f"{self.path}/{table}"
        folders = [f"{root}/attempt={attempt}/year={year}" for attempt, year in self._listed(years)]
        full = T.StructType([*schema.fields, _YEAR, _ATTEMPT])
        if not folders:
            return self.spark.createDataFrame([], full).drop("attempt").filter(F.lit(False))
        reader = self.spark.read.schema(full).option("basePath", root)
        return reader.parquet(*sorted(folders)).drop("attempt")

    def features(self, years: Iterable[int] | None = None) -> DataFrame:
        """The panel with its window columns, as of the last update."""
        return self._read(TABLE, self.schema, years).drop("year")

    def matrix(self, params: DataFrame, years: Iterable[int] | None = None) -> DataFrame:
        """The features with the indices of the long sums, against stored parameters (``spi.fit_spi``)."""
        return transform_spi(self.features(years), params, {c: f"spi_{n}d" for n, c in SUMS.items()})

    def update(self, batch: DataFrame) -> list[int]:
        """Take in a batch of rows, one per division and day; the years that were written again.

        A day that is stored already is replaced. Rows without a day are an error. Starts jobs;
        the lists of years are all that reaches the driver.
        """
        own = [*self._panel.fieldNames()]
        fresh = settle(batch.select(*own).withColumn("year", F.year(DATE)), "batch")
        changed = self._years_of(fresh)
        if None in changed:
            raise ValueError("rows without a day have no place in the table")
        if not changed:
            return []
        marked = fresh.withColumn("_changed", F.lit(1))
        if self._listed(changed):
            kept = self._unlike(self._read(TABLE, self._panel, changed), fresh)
            marked = settle(kept.withColumn("_changed", F.lit(None).cast("int")).unionByName(marked), "merged")
        needed = self._needed_years(fresh, marked, changed)
        others = self._read(TABLE, self._panel, set(needed) - set(changed))
        rows = marked.unionByName(others.withColumn("_changed", F.lit(None).cast("int")))
        if self._listed(needed):
            touched = settle(fresh.select(DIVISION).distinct(), "touched")
            rows = self._alike(rows, touched, [DIVISION])
        return self._replace(self._windows(rows))

    def _years_of(self, rows: DataFrame) -> list[int]:
        years = [r["year"] for r in rows.select("year").distinct().collect()]
        return sorted(years, key=lambda y: (y is not None, y))

    def _same(self, keys: list[str]):
        same = F.lit(True)
        for key in keys:
            same = same & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
        return same

    def _unlike(self, rows: DataFrame, others: DataFrame) -> DataFrame:
        return rows.alias("l").join(others.select(*KEY).alias("r"), self._same(KEY), "left_anti")

    def _alike(self, rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
        return rows.alias("l").join(others.alias("r"), self._same(keys), "left_semi")

    def _needed_years(self, fresh: DataFrame, merged: DataFrame, changed: list[int]) -> list[int]:
        """Years that hold a changed row, or one of the ``REACH`` rows before or after it."""
        stored = self._read(COUNTS, self._counts).filter(~F.col("year").isin(changed))
        now = merged.groupBy(DIVISION, "year").agg(F.count(F.lit(1)).alias("rows"))
        counts = stored.select(DIVISION, "year", "rows").unionByName(now.select(DIVISION, "year", "rows"))
        by_year = Window.partitionBy(DIVISION).orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("rows").over(by_year), F.lit(0)))
        hit = self._alike(counts, fresh.select(DIVISION, "year").distinct(), [DIVISION, "year"])
        starts = hit.select(
            F.col(DIVISION).alias("_d"),
            F.col("before").alias("_first"),
            (F.col("before") + F.col("rows")).alias("_end"),
        )
        near = F.col(DIVISION).eqNullSafe(F.col("_d")) & (
            (F.col("before") + F.col("rows") > F.col("_first") - REACH)
            & (F.col("before") < F.col("_end") + REACH)
        )
        return self._years_of(counts.join(starts, near, "left_semi"))

    def _windows(self, marked: DataFrame) -> DataFrame:
        """Window columns of the rows that a marked one reaches."""
        stages, helpers = rolling_sums("rain_sum", SUMS)

        def reached(window) -> dict:
            return {"_near": F.max("_changed").over(window.rowsBetween(-REACH, 0))}

        done = over_rows(marked, antecedent_rain, *stages, reached, back=REACH).filter("_near = 1")
        return done.select(*self.schema.fieldNames(), "year")

    def _replace(self, affected: DataFrame) -> list[int]:
        """Write the affected rows, then the other rows of their years beside them, and commit these years."""
        attempt = uuid.uuid4().hex
        folder = f"{self.path}/{TABLE}/attempt={attempt}"
        self._write(affected, folder)
        full = T.StructType([*self.schema.fields, _YEAR])
        written = self.spark.read.schema(full).parquet(folder)
        years = self._years_of(written)
        if not years:
            return []
        if self._listed(years):
            self._write(self._unlike(self._read(TABLE, self.schema, years), written), folder)
            written = self.spark.read.schema(full).parquet(folder)
        counts = written.groupBy(DIVISION, "year").agg(F.count(F.lit(1)).alias("rows"))
        counts.hint("rebalance", F.col("year")).write.partitionBy("year").parquet(
            f"{self.path}/{COUNTS}/attempt={attempt}"
        )
        commit(self.spark, self.path, TASK, [str(y) for y in years], attempt)
        return years

    def _write(self, rows: DataFrame, folder: str) -> None:
        spread = rows.hint("rebalance", F.col("year"))
        spread.write.mode("append").partitionBy("year").option("compression", "zstd").parquet(folder)
