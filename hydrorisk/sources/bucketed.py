"""A panel stored in buckets by division, sorted by day, so that windows and fits by division need no shuffle.

Buckets are known to Spark through its catalog: ``write_bucketed`` registers the table, and
``attach_bucketed`` registers stored files again in another session. Choose as many buckets as
tasks are to work on the whole panel; a division is in one bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from hydrorisk.schemas import DATE, DIVISION


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Store a panel under ``path`` as an unmanaged table, one file per bucket; read it back."""
    # One task per bucket writes one file of it.
    spread = df.repartition(buckets, DIVISION)
    writer = spread.write.format("parquet").bucketBy(buckets, DIVISION).sortBy(DIVISION, DATE)
    writer.option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def attach_bucketed(
    spark: SparkSession, table: str, path: str, schema: T.StructType, buckets: int
) -> DataFrame:
    """Register files that ``write_bucketed`` stored, with the same number of buckets."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet"
        f" CLUSTERED BY ({DIVISION}) SORTED BY ({DIVISION}, {DATE}) INTO {int(buckets)} BUCKETS"
        f" LOCATION '{path}'"
    )
    return spark.table(table)


def exchanges(df: DataFrame) -> int:
    """Shuffles in the plan of a frame."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(line.lstrip(" :+-*()0123456789").startswith("Exchange") for line in plan.splitlines())
