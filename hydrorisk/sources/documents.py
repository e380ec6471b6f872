"""Landed JSON documents: one block of parallel arrays per division."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrorisk.functions.scalars import local_day, no_nan, round_decimal
from hydrorisk.schemas import DATE, DIVISION, document_schema


def read_documents(spark: SparkSession, path: str, block: str, measures: list[str]) -> DataFrame:
    """One JSON document per line, with its division."""
    return spark.read.schema(document_schema(block, measures)).json(path)


def parse_documents(df: DataFrame, text: str, block: str, measures: list[str]) -> DataFrame:
    """Documents held as JSON text in a column."""
    schema = document_schema(block, measures)
    return df.select(F.from_json(text, schema).alias("_doc")).select("_doc.*")


def _explode_block(df: DataFrame, block: str, measures: list[str]) -> DataFrame:
    """One row per array position, up to the shortest array; an absent array ends all."""
    arrays = ["time", *measures]
    shortest = F.least(*[F.coalesce(F.size(f"{block}.{a}"), F.lit(0)) for a in arrays])
    cut = df.select(
        DIVISION,
        *[F.slice(f"{block}.{a}", F.lit(1), F.greatest(shortest, F.lit(0))).alias(a) for a in arrays],
    )
    rows = cut.select(DIVISION, F.inline(F.arrays_zip(*arrays)))
    return rows.withColumns({m: no_nan(F.col(m)) for m in measures})


def explode_daily(df: DataFrame, measures: list[str]) -> DataFrame:
    """Daily documents → date, division, measures."""
    rows = _explode_block(df, "daily", measures)
    return rows.select(local_day("time").alias(DATE), DIVISION, *measures)


def explode_hourly(df: DataFrame, measures: list[str]) -> DataFrame:
    """Hourly documents → local time text, day, division, measures."""
    rows = _explode_block(df, "hourly", measures)
    return rows.select("time", local_day("time").alias(DATE), DIVISION, *measures)


def failed_documents(df: DataFrame, block: str) -> DataFrame:
    """Divisions whose document has no time axis: to be fetched again, not empty data."""
    return df.filter(F.coalesce(F.size(f"{block}.time"), F.lit(0)) <= 0).select(DIVISION)


def hourly_to_daily(df: DataFrame, measures: list[str], digits: int | None = 4) -> DataFrame:
    """Daily mean of the hours present, per division; days without any value give no row.

    ``digits=None`` leaves the means unrounded.
    """
    means = {m: F.avg(m) for m in measures}
    if digits is not None:
        means = {m: round_decimal(mean, digits) for m, mean in means.items()}
    return (
        df.filter(F.coalesce(*measures).isNotNull())
        .groupBy(DIVISION, DATE)
        .agg(*[mean.alias(m) for m, mean in means.items()])
    )
