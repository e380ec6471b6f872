"""Resumable landing: a manifest of finished (task, division) pairs and idempotent writes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrorisk.schemas import DIVISION, MANIFEST

# Partition column of landed tables: task and batch.
LANDING = "landing"
_BATCH = T.StructField(LANDING, T.StringType())


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Import a JSON object task → [divisions] as (task, division) rows."""
    text = spark.read.text(path, wholetext=True)
    return parse_manifest(text, "value")


def parse_manifest(df: DataFrame, text: str) -> DataFrame:
    """The same from JSON text in a column."""
    tasks = df.select(F.explode(F.from_json(text, "map<string,array<string>>")).alias("task", "ids"))
    return tasks.select("task", F.explode("ids").alias(DIVISION))


def stored_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest table, empty if nothing has landed yet."""
    try:
        stored = spark.read.schema(MANIFEST).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)
    return stored.dropDuplicates()


def pending(registry: DataFrame, manifest: DataFrame, task: str) -> DataFrame:
    """Registry entries that this task has not finished."""
    done = manifest.filter(F.col("task") == task).select(F.col(DIVISION).alias("id"))
    return registry.join(done, "id", "left_anti")


def mark_done(manifest: DataFrame, divisions: DataFrame, task: str) -> DataFrame:
    """The manifest with the divisions added for this task, as a set."""
    return manifest.unionByName(
        divisions.select(F.lit(task).alias("task"), DIVISION)
    ).dropDuplicates(["task", DIVISION])


def manifest_counts(manifest: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """Finished divisions per task; with ``tasks`` (task) also those with none, as 0."""
    counts = manifest.groupBy("task").agg(F.count(F.lit(1)).alias("completed"))
    if tasks is None:
        return counts
    return (
        tasks.select("task")
        .distinct()
        .join(counts, "task", "left")
        .select("task", F.coalesce("completed", F.lit(0)).cast("bigint").alias("completed"))
    )


def manifest_tasks(df: DataFrame, text: str) -> DataFrame:
    """Tasks named in manifest documents, those without divisions among them."""
    tasks = df.select(F.explode(F.from_json(text, "map<string,array<string>>")).alias("task", "ids"))
    return tasks.select("task").distinct()


def manifest_reset(manifest: DataFrame, task: str) -> DataFrame:
    return manifest.filter(F.col("task") != task)


def land(df: DataFrame, path: str, manifest_path: str, task: str, batch: str) -> None:
    """Write a batch of rows, then mark its divisions done.

    The batch is the unit that a repeated run replaces: landing it again, after a crash
    between the two writes or with corrected rows, cannot duplicate a row, and other
    batches of the same divisions stay. ``df`` is evaluated once; the marks come from
    what was written. Divisions without rows are not marked, nor is one twice; a NULL
    division is marked like any other. The rebalance hint lets a large batch use several tasks.
    """
    spark = df.sparkSession
    own = f"{task}-{batch}"
    (
        df.withColumn(LANDING, F.lit(own))
        .hint("rebalance")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(LANDING)
        .parquet(path)
    )
    written = read_landed(spark, path, df.schema, own)
    landed = written.select(F.lit(task).alias("task"), DIVISION).distinct()
    known = stored_manifest(spark, manifest_path).toDF("_task", "_division")
    same = (F.col("task") == F.col("_task")) & F.col(DIVISION).eqNullSafe(F.col("_division"))
    landed.join(known, same, "left_anti").write.mode("append").parquet(manifest_path)


def read_landed(
    spark: SparkSession, path: str, schema: T.StructType, batch: str | None = None
) -> DataFrame:
    """Landed rows in the given schema, so that ids like 007 stay text; one batch of them if named."""
    columns = [f.name for f in schema.fields]
    stored = spark.read.schema(T.StructType([*schema.fields, _BATCH])).parquet(path)
    if batch is not None:
        stored = stored.filter(F.col(LANDING) == batch)
    return stored.select(*columns)
