"""Profiling and reconciliation of landed data against the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrorisk.functions.scalars import no_nan, round_decimal, safe_double
from hydrorisk.schemas import DATE, DIVISION


def profile(df: DataFrame, measures: list[str]) -> DataFrame:
    """One row per measure: table size and range, and the measure's statistics.

    A missing division counts as one, as in :func:`coverage`. One aggregation pass; text measures are read leniently.
    """
    kinds = dict(df.dtypes)
    values = {
        m: safe_double(m) if kinds[m] == "string" else no_nan(F.col(m).cast("double"))
        for m in measures
    }
    aggregates = [
        F.count(F.lit(1)).alias("rows"),
        (
            F.count_distinct(DIVISION)
            + F.coalesce(F.max(F.col(DIVISION).isNull().cast("int")), F.lit(0))
        ).alias("divisions"),
        F.min(DATE).alias("date_min"),
        F.max(DATE).alias("date_max"),
    ]
    for m, x in values.items():
        aggregates += [
            F.min(x).alias(f"{m}_min"),
            F.max(x).alias(f"{m}_max"),
            F.avg(x).alias(f"{m}_mean"),
            F.count_if(x.isNull()).alias(f"{m}_nulls"),
        ]
    share = F.coalesce(
        F.try_divide(F.lit(100.0) * F.col("null_count"), F.col("rows")), F.lit(0.0)
    )
    per_measure = F.array(
        *[
            F.struct(
                F.lit(m).alias("measure"),
                F.col(f"{m}_min").alias("min"),
                F.col(f"{m}_max").alias("max"),
                F.col(f"{m}_mean").alias("mean"),
                F.col(f"{m}_nulls").alias("null_count"),
            )
            for m in measures
        ]
    )
    return (
        df.agg(*aggregates)
        .select("rows", "divisions", "date_min", "date_max", F.inline(per_measure))
        .withColumns({c: round_decimal(F.col(c), 4) for c in ("min", "max", "mean")})
        .withColumn("null_pct", round_decimal(share, 2))
    )


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows per class, most frequent first."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    return counts.orderBy(F.desc("rows"), label)


def missing_divisions(registry: DataFrame, df: DataFrame) -> DataFrame:
    """Registered divisions without any row, sorted."""
    found = df.select(F.col(DIVISION).alias("id")).distinct()
    return registry.join(found, "id", "left_anti").select("id").orderBy("id")


def reconcile_names(requested: DataFrame, registry: DataFrame) -> DataFrame:
    """Requested names that are not registered, sorted."""
    names = requested.select("name").distinct()
    known = registry.select(F.col("id").alias("name")).distinct()
    return names.join(known, "name", "left_anti").orderBy("name")


def reconcile_counts(requested: DataFrame, registry: DataFrame) -> DataFrame:
    """How many distinct names were requested and how many of them are unknown."""
    names = requested.select("name").distinct()
    known = registry.select(F.col("id").alias("name"), F.lit(True).alias("known")).distinct()
    return names.join(known, "name", "left").agg(
        F.count(F.lit(1)).alias("requested"), F.count_if(F.col("known").isNull()).alias("missing")
    )


def coverage(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Divisions found against registered, as percentage and 20-cell bar.

    All found ids count, registered or not, so the share may exceed 100 %. The bar's cells
    and its width are fixed values.
    """
    found = df.select(DIVISION).distinct().select(F.lit("found").alias("side"))
    expected = registry.select(F.lit("expected").alias("side"))
    sides = found.unionByName(expected).agg(
        *[F.count_if(F.col("side") == side).alias(side) for side in ("found", "expected")]
    )
    share = F.coalesce(
        F.try_divide(F.lit(100.0) * F.col("found"), F.col("expected")), F.lit(0.0)
    )
    filled = F.floor(share / 5).cast("int")
    bar = F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(20) - filled))
    return sides.select(
        "found",
        "expected",
        round_decimal(share, 1).alias("coverage_pct"),
        bar.alias("coverage_bar"),
    )


def registry_rollup(registry: DataFrame) -> DataFrame:
    """Members per (province, district), per province and in total.

    Totals carry ``TOTAL`` in the columns they run over.
    """
    return (
        registry.rollup("province", "district")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.grouping("province").alias("_all"),
            F.grouping("district").alias("_sum"),
        )
        .select(
            F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("province")).alias("province"),
            F.when(F.col("_sum") == 1, "TOTAL").otherwise(F.col("district")).alias("district"),
            "members",
        )
    )


def registry_members(registry: DataFrame, level: str) -> DataFrame:
    """Member names of every district or province with the group's size, in report order.

    Names come as sorted rows, so a large group is never gathered into one value.
    """
    sizes = registry.groupBy(level).agg(F.count(F.lit(1)).alias("members"))
    return registry.select(level, "id").join(sizes, level).orderBy(level, "id")


def expected_days(start: Column, end: Column) -> Column:
    """Days from start to end, the end day not counted (as the reports count)."""
    return F.datediff(end, start)


def expected_days_inclusive(start: Column, end: Column) -> Column:
    """Days from start to end, both counted."""
    return F.datediff(end, start) + 1
