"""Reading and writing measurement and panel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrorisk.functions.scalars import no_nan
from hydrorisk.schemas import DATE, measurement_schema


def without_nan(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: no_nan(F.col(c)) for c in doubles}) if doubles else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, explicit schema; blank or unreadable cells are missing."""
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    return without_nan(reader.option("dateFormat", "yyyy-MM-dd").csv(path))


def read_measurement(spark: SparkSession, path: str, measures: list[str]) -> DataFrame:
    """Daily measurement file: date, division and the named measures."""
    return read_csv(spark, path, measurement_schema(measures))


def read_panel(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    first_day: str | None = None,
) -> DataFrame:
    """A stored panel; with a schema the path is CSV, otherwise a written panel.

    ``first_day`` prunes whole years of a written panel before reading.
    """
    df = read_csv(spark, path, schema) if schema else spark.read.parquet(path)
    if first_day:
        day = F.lit(first_day).cast("date")
        if "year" in df.columns:
            df = df.filter(F.col("year") >= F.year(day))
        df = df.filter(F.col(DATE) >= day)
    return df.drop("year")


def write_panel(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store a panel as Parquet by year, in a path other than any it was read from.

    The rebalance hint keeps files few and lets a large year use several tasks.
    """
    by_year = df.withColumn("year", F.year(DATE)).hint("rebalance", F.col("year"))
    # A panel write replaces the whole table, not only the years present.
    writer = by_year.write.mode(mode).option("partitionOverwriteMode", "static")
    writer.partitionBy("year").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store a table as CSV with a header; missing cells are blank."""
    df.write.mode(mode).option("header", True).csv(path)


def dataset_size(spark: SparkSession, path: str) -> DataFrame:
    """Files, bytes and readable size of a data set, from the file listing alone.

    Megabytes below 1000, gigabytes from there on, two decimals.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    mb = F.col("bytes") / F.lit(1024.0**2)
    readable = F.when(
        mb >= 1000, F.concat(F.format_string("%.2f", mb / 1024), F.lit(" GB"))
    ).otherwise(F.concat(F.format_string("%.2f", mb), F.lit(" MB")))
    return (
        listing.select("path", "length")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        )
        .withColumn("size", readable)
    )
