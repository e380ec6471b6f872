"""Reading files whose broken records are set apart, with their file and text, not dropped or blanked.

Each reader gives the good rows and a table of rejects: ``file``, ``record`` (the raw text, NULL
where the record was read well but lacks a key), ``reason``. Good rows are what the plain
readers give of the same records.

A job parses the files once, all columns of them, into a staged table that both parts are read
from: a query of few columns would otherwise not parse, and not find, broken cells in the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrorisk.schemas import DATE, DIVISION, document_schema, measurement_schema
from hydrorisk.session import settle
from hydrorisk.sources.tables import without_nan

RECORD = "_record"
MALFORMED, NO_KEY = "malformed", "no key"


@dataclass(frozen=True)
class Checked:
    """Good rows, and rejects (file, record, reason)."""

    rows: DataFrame
    rejects: DataFrame


def _with_record(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(RECORD, T.StringType())])


def _split(read: DataFrame, columns: list[str], keyless: Column) -> Checked:
    read = settle(read, "checked")
    bad = F.col(RECORD).isNotNull()
    lacks_key = F.coalesce(keyless, F.lit(True))
    rejects = read.filter(bad | lacks_key).select(
        "file", F.col(RECORD).alias("record"), F.when(bad, MALFORMED).otherwise(NO_KEY).alias("reason")
    )
    return Checked(read.filter(~bad & ~lacks_key).select(*columns), rejects)


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> Checked:
    """CSV with a header: records with a cell that its type cannot hold, or without a key, are rejects.

    A blank cell is missing, as in ``read_csv``; a blank key makes a reject.
    """
    read = (
        spark.read.schema(_with_record(schema))
        .option("header", True)
        .option("dateFormat", "yyyy-MM-dd")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", RECORD)
        .csv(path)
        .select("*", F.col("_metadata.file_path").alias("file"))
    )
    keyless = F.lit(False)
    for key in keys:
        keyless = keyless | F.col(key).isNull()
    checked = _split(read, schema.fieldNames(), keyless)
    return Checked(without_nan(checked.rows), checked.rejects)


def read_measurement_checked(spark: SparkSession, path: str, measures: list[str]) -> Checked:
    """Daily measurement files; rows without a day or a division are rejects."""
    return read_csv_checked(spark, path, measurement_schema(measures), [DATE, DIVISION])


def read_documents_checked(spark: SparkSession, path: str, block: str, measures: list[str]) -> Checked:
    """One JSON document per line: broken documents, and those without a division, are rejects.

    A document that says nothing of its time axis is well-formed: ``failed_documents`` finds it.
    """
    schema = document_schema(block, measures)
    read = (
        spark.read.schema(_with_record(schema))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", RECORD)
        .json(path)
        .select("*", F.col("_metadata.file_path").alias("file"))
    )
    return _split(read, schema.fieldNames(), F.col(DIVISION).isNull())


def keep_rejects(checked: Checked, path: str) -> DataFrame:
    """Write the rejects as a table beside those of earlier reads; the whole table."""
    checked.rejects.write.mode("append").parquet(path)
    return checked.rejects.sparkSession.read.schema(checked.rejects.schema).parquet(path)
