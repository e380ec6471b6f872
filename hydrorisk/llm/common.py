"""Column expressions and small helpers that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale and the other letters."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def whole_text(column: str) -> Column:
    """The text with NULL as the empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_key(column: str) -> Column:
    """A never-NULL text form of an id, so that NULL ids meet in plain equalities."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_rows(docs: DataFrame, **columns: Column) -> DataFrame:
    """Working columns beside all original ones, packed in ``row``, so that no names clash."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        *[column.alias(name) for name, column in columns.items()],
    )


def original(rows: DataFrame) -> DataFrame:
    """Back from ``as_rows`` to the original columns."""
    return rows.select("row.*")
