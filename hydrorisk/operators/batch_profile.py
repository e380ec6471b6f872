"""Profiles per landing batch that merge, so that the profile of a table is no scan of it.

A batch is reduced once to one row: counts, ranges and exact sums, a HyperLogLog sketch of
its divisions and a KLL sketch of each measure. The rows are landed as committed batches, so a
batch that lands again replaces its own. The profile of all batches is their merge: its counts,
ranges and means are exact, ``divisions`` and the quantiles are within the sketches' error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrorisk.functions.scalars import no_nan
from hydrorisk.schemas import DATE, DIVISION
from hydrorisk.sources.committed import land_committed, read_committed

TASK = "profile"
# log2 of the HyperLogLog registers: 12 keeps the relative standard error at 1.6 %.
REGISTERS = 12
# Size of the KLL sketches: 200 keeps ranks within about 1.3 % (normalised).
KLL_SIZE = 200
QUANTILES = [0.25, 0.5, 0.75]
# Unit of the exact part of a sum, as in ``baseline``.
UNIT = float(1 << 20)


def _schema(measures: list[str]) -> T.StructType:
    fields = [
        T.StructField("rows", T.LongType()),
        T.StructField("date_min", T.DateType()),
        T.StructField("date_max", T.DateType()),
        T.StructField("division_sketch", T.BinaryType()),
        T.StructField("unnamed", T.BooleanType()),
    ]
    for m in measures:
        fields += [
            T.StructField(f"{m}_present", T.LongType()),
            T.StructField(f"{m}_min", T.DoubleType()),
            T.StructField(f"{m}_max", T.DoubleType()),
            T.StructField(f"{m}_whole", T.DecimalType(38, 0)),
            T.StructField(f"{m}_rest", T.DoubleType()),
            T.StructField(f"{m}_sketch", T.BinaryType()),
        ]
    return T.StructType(fields)


def batch_profile(df: DataFrame, measures: list[str]) -> DataFrame:
    """The one-row, mergeable profile of a batch; one aggregation."""
    parts = [
        F.count(F.lit(1)).alias("rows"),
        F.min(DATE).alias("date_min"),
        F.max(DATE).alias("date_max"),
        F.hll_sketch_agg(F.col(DIVISION).cast("string"), F.lit(REGISTERS)).alias("division_sketch"),
        F.coalesce(F.bool_or(F.col(DIVISION).isNull()), F.lit(False)).alias("unnamed"),
    ]
    for m in measures:
        x = no_nan(F.col(m).cast("double"))
        whole = F.rint(x * UNIT)
        parts += [
            F.count(x).alias(f"{m}_present"),
            F.min(x).alias(f"{m}_min"),
            F.max(x).alias(f"{m}_max"),
            F.coalesce(F.sum(whole.cast("decimal(28,0)")), F.lit(0)).cast("decimal(38,0)").alias(f"{m}_whole"),
            F.coalesce(F.sum(x * UNIT - whole), F.lit(0.0)).alias(f"{m}_rest"),
            F.kll_sketch_agg_double(x, F.lit(KLL_SIZE)).alias(f"{m}_sketch"),
        ]
    return df.agg(*parts)


def land_profile(df: DataFrame, path: str, batch: str, measures: list[str]) -> None:
    """Reduce a landing batch and land its profile; the same batch again replaces it."""
    land_committed(batch_profile(df, measures).select(*_schema(measures).fieldNames()), path, TASK, batch)


def _merge(sketch: Column) -> Column:
    """All KLL sketches of the group in one; a sketch has a bounded size, a batch one sketch."""
    return F.kll_merge_agg_double(sketch, F.lit(KLL_SIZE))


def merged_profile(spark: SparkSession, path: str, measures: list[str]) -> DataFrame:
    """One row per measure over all batches that count, from their profiles alone.

    rows, divisions (estimated), date_min, date_max, measure, min, max, mean, null_count, quantiles.
    """
    stored = read_committed(spark, path, _schema(measures), TASK)
    parts = [
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.min("date_min").alias("date_min"),
        F.max("date_max").alias("date_max"),
        F.hll_sketch_estimate(F.hll_union_agg("division_sketch")).alias("named"),
        F.coalesce(F.bool_or("unnamed"), F.lit(False)).cast("bigint").alias("unnamed"),
    ]
    for m in measures:
        parts += [
            F.coalesce(F.sum(f"{m}_present"), F.lit(0)).alias(f"{m}_present"),
            F.min(f"{m}_min").alias(f"{m}_min"),
            F.max(f"{m}_max").alias(f"{m}_max"),
            F.sum(f"{m}_whole").alias(f"{m}_whole"),
            F.sum(f"{m}_rest").alias(f"{m}_rest"),
            _merge(F.col(f"{m}_sketch")).alias(f"{m}_sketch"),
        ]
    whole = stored.agg(*parts)
    per_measure = [
        F.struct(
            F.lit(m).alias("measure"),
            F.col(f"{m}_min").alias("min"),
            F.col(f"{m}_max").alias("max"),
            F.try_divide(
                (F.col(f"{m}_whole").cast("double") + F.col(f"{m}_rest")) / UNIT,
                F.col(f"{m}_present").cast("double"),
            ).alias("mean"),
            (F.col("rows") - F.col(f"{m}_present")).alias("null_count"),
            F.when(
                F.col(f"{m}_present") > 0,
                F.kll_sketch_get_quantile_double(F.col(f"{m}_sketch"), F.array(*map(F.lit, QUANTILES))),
            ).alias("quantiles"),
        )
        for m in measures
    ]
    divisions = (F.coalesce("named", F.lit(0)) + F.col("unnamed")).alias("divisions")
    return whole.select("rows", divisions, "date_min", "date_max", F.inline(F.array(*per_measure)))
