"""A precipitation baseline that grows, shrinks and is corrected batch by batch.

What a gamma fit needs of a division is sufficient statistics: present values, exact zeros,
positive values, their sum and the sum of their logarithms. They add up over batches, so a
batch is reduced to one row per division once, when it lands, and landed as a committed batch
of its own (``sources.committed``). Landing it again replaces its statistics, removing it takes
them away; the fit sums one small row per division and batch and never reads the
history. Compaction folds many batches into one.

Sums are kept in two parts, a whole number of 2^-20 that adds exactly in any order, and what is
left below it, so that taking a batch away leaves what a fit without it would have had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrorisk.functions.scalars import no_nan
from hydrorisk.operators.spi import fit_from_stats
from hydrorisk.schemas import DIVISION, RAIN
from hydrorisk.sources.committed import compact, land_committed, read_committed

TASK = "baseline"
# Unit of the exact part of a sum; sums up to 10^31 units fit the decimal.
UNIT = float(1 << 20)
_WHOLE = "decimal(38,0)"


def _statistics_schema(columns: list[str], by: str = DIVISION) -> T.StructType:
    fields = [T.StructField(by, T.StringType())]
    for c in columns:
        fields += [T.StructField(f"{c}_{n}", T.LongType()) for n in ("n", "zeros", "positives")]
        for s in ("sum", "log"):
            fields += [
                T.StructField(f"{c}_{s}_whole", T.DecimalType(38, 0)),
                T.StructField(f"{c}_{s}_rest", T.DoubleType()),
            ]
    return T.StructType(fields)


def _two_parts(value: Column, name: str) -> list[Column]:
    whole = F.rint(value * UNIT)
    return [
        F.coalesce(F.sum(whole.cast("decimal(28,0)")), F.lit(0)).cast(_WHOLE).alias(f"{name}_whole"),
        F.coalesce(F.sum(value * UNIT - whole), F.lit(0.0)).alias(f"{name}_rest"),
    ]


def batch_statistics(df: DataFrame, columns: list[str], by: str = DIVISION) -> DataFrame:
    """One row of mergeable statistics per division; one aggregation with map-side partials."""
    parts = []
    for c in columns:
        x = no_nan(F.col(c).cast("double"))
        positive = F.when(x > 0, x)
        parts += [
            F.count(x).alias(f"{c}_n"),
            F.count_if(x == 0).alias(f"{c}_zeros"),
            F.count(positive).alias(f"{c}_positives"),
            *_two_parts(positive, f"{c}_sum"),
            *_two_parts(F.ln(positive), f"{c}_log"),
        ]
    return df.groupBy(F.col(by).cast("string").alias(by)).agg(*parts)


def merged(statistics: DataFrame, by: str = DIVISION) -> DataFrame:
    """Statistics of several batches added up."""
    sums = [F.sum(f.name).cast(f.dataType).alias(f.name) for f in statistics.schema if f.name != by]
    return statistics.groupBy(by).agg(*sums)


def stats_of(statistics: DataFrame, columns: list[str], by: str = DIVISION) -> DataFrame:
    """Merged statistics in the form of ``spi.gamma_stats``: n, share of zeros, mean, mean log."""

    def mean(name: str, count: str) -> Column:
        total = (F.col(f"{name}_whole").cast("double") + F.col(f"{name}_rest")) / UNIT
        return F.try_divide(total, F.col(count).cast("double"))

    result = []
    for c in columns:
        share = F.try_divide(F.col(f"{c}_zeros").cast("double"), F.col(f"{c}_n").cast("double"))
        result += [
            F.col(f"{c}_n"),
            share.alias(f"{c}_q"),
            mean(f"{c}_sum", f"{c}_positives").alias(f"{c}_mean"),
            mean(f"{c}_log", f"{c}_positives").alias(f"{c}_mean_log"),
        ]
    return statistics.select(by, *result)


def add_to_baseline(df: DataFrame, path: str, batch: str, columns: list[str] | None = None) -> None:
    """Reduce a batch of rows to its statistics and land them; the same batch again replaces them."""
    columns = columns or [RAIN]
    land_committed(batch_statistics(df, columns), path, TASK, batch)


def remove_from_baseline(
    spark: SparkSession, path: str, batch: str, columns: list[str] | None = None
) -> None:
    """Take a batch out again: its commit now points to no rows."""
    empty = spark.createDataFrame([], _statistics_schema(columns or [RAIN]))
    land_committed(empty, path, TASK, batch, note="removed")


def baseline_statistics(
    spark: SparkSession, path: str, columns: list[str] | None = None
) -> DataFrame:
    """Statistics of all batches that count, one row per division."""
    schema = _statistics_schema(columns or [RAIN])
    return merged(read_committed(spark, path, schema, TASK))


def baseline_params(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Fitted parameters per division, as ``spi.fit_spi`` over all rows of all batches gives them."""
    columns = columns or [RAIN]
    return fit_from_stats(stats_of(baseline_statistics(spark, path, columns), columns), columns)


def compact_baseline(spark: SparkSession, path: str, columns: list[str] | None = None) -> int:
    """Put the statistics of all batches into few files; each batch can still be replaced."""
    return compact(spark, path, _statistics_schema(columns or [RAIN]), TASK)
