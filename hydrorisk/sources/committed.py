"""Committed landing: what a batch wrote is read only once its commit is there.

Under one path:

* ``<table>/attempt=<id>/`` holds the rows that one attempt wrote, with their task and batch;
* ``marks/attempt=<id>/`` holds the divisions found in what was written;
* ``commits/`` holds one small file per commit: task, batch, attempt, sequence, note.

Of the commits of a (task, batch) the one with the highest sequence counts. An attempt never
touches the files of another, so a crash before the commit leaves nothing that a reader
sees, a batch that lands again replaces itself in one step, and a reader that is already open
goes on reading the files it found. Compaction is an attempt like any other: it holds the
rows of many batches, and its one commit moves them all. ``vacuum`` deletes what no
commit points to any more.

One writer at a time commits to a (task, batch). The commits are metadata, one row per batch:
readers take their list to the driver, as they do with the list of files; compaction
bounds the number of attempts that are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrorisk.schemas import DIVISION, MANIFEST

COMMIT = "task string, batch string, attempt string, sequence bigint, note string"
ROWS = "rows"
_OWN = [T.StructField("_task", T.StringType()), T.StructField("_batch", T.StringType())]
_ATTEMPT = T.StructField("attempt", T.StringType())


def _stored(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A stored table, empty where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def current_commits(spark: SparkSession, path: str, task: str | None = None) -> DataFrame:
    """The commit that counts of every (task, batch)."""
    commits = _stored(spark, f"{path}/commits", COMMIT)
    if task is not None:
        commits = commits.filter(F.col("task") == task)
    newest = F.max(F.struct("sequence", "attempt", "note")).alias("newest")
    return commits.groupBy("task", "batch").agg(newest).select(
        "task", "batch", "newest.attempt", "newest.sequence", "newest.note"
    )


def last_commit(spark: SparkSession, path: str, task: str, before: str | None = None):
    """The commit of the highest batch name of a task, below ``before`` if given; None without any."""
    commits = current_commits(spark, path, task)
    if before is not None:
        commits = commits.filter(F.col("batch") < before)
    return commits.orderBy(F.col("batch").desc()).first()


def commit(
    spark: SparkSession, path: str, task: str, batches: Iterable[str], attempt: str, note: str | None = None
) -> None:
    """Let ``attempt`` count for the batches from now on: one file, written in one step."""
    highest = _stored(spark, f"{path}/commits", COMMIT).agg(F.max("sequence")).first()[0] or 0
    rows = [(task, batch, attempt, highest + 1, note) for batch in batches]
    spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def write_attempt(df: DataFrame, path: str, task: str, batch: str, attempt: str, table: str = ROWS) -> None:
    """Write rows where no reader looks before the attempt is committed."""
    own = df.withColumns({"_task": F.lit(task), "_batch": F.lit(batch)}).hint("rebalance")
    own.write.parquet(f"{path}/{table}/attempt={attempt}")


def _write_marks(spark: SparkSession, path: str, schema: T.StructType, attempt: str) -> None:
    """The divisions of an attempt, taken from what it wrote."""
    own = T.StructType([*schema.fields, *_OWN])
    written = spark.read.schema(own).parquet(f"{path}/{ROWS}/attempt={attempt}")
    marks = written.select("_task", "_batch", DIVISION).distinct()
    marks.write.parquet(f"{path}/marks/attempt={attempt}")


def land_committed(df: DataFrame, path: str, task: str, batch: str, note: str | None = None) -> None:
    """Land a batch: rows, then marks, then the commit that shows both.

    The same batch landed again replaces the earlier one. ``df`` is evaluated once.
    """
    attempt = uuid.uuid4().hex
    write_attempt(df, path, task, batch, attempt)
    if DIVISION in df.columns:
        _write_marks(df.sparkSession, path, df.schema, attempt)
    commit(df.sparkSession, path, task, [batch], attempt, note)


def landing_sink(path: str, task: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: every micro-batch is landed under its id.

    A stream that starts again repeats its last batch if that was not finished; the repeat
    replaces what the first try had landed, so each row counts once.
    """

    def sink(rows: DataFrame, batch_id: int) -> None:
        land_committed(rows, path, task, f"{batch_id:018d}")

    return sink


def read_committed(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    task: str | None = None,
    batches: Iterable[str] | None = None,
    table: str = ROWS,
    with_batch: bool = False,
) -> DataFrame:
    """Committed rows, of one task or of some of its batches if named.

    Only folders of attempts that count are listed and read. ``with_batch`` adds ``_task``
    and ``_batch``.
    """
    current = current_commits(spark, path, task)
    if batches is not None:
        current = current.filter(F.col("batch").isin(list(batches)))
    listed = current.select("task", "batch", "attempt").collect()
    full = T.StructType([*schema.fields, *_OWN, _ATTEMPT])
    attempts = sorted({row["attempt"] for row in listed})
    stored = spark.createDataFrame([], full)
    if attempts:
        folders = [f"{path}/{table}/attempt={a}" for a in attempts]
        stored = spark.read.schema(full).option("basePath", f"{path}/{table}").parquet(*folders)
    # A compacted attempt also holds batches that have landed again since.
    counts = spark.createDataFrame(listed, "_task string, _batch string, attempt string")
    rows = stored.join(counts, ["_task", "_batch", "attempt"], "left_semi")
    return rows.select(*[f.name for f in schema.fields], *(["_task", "_batch"] if with_batch else []))


def committed_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(task, division) of all that is committed, for ``landing.pending``."""
    marks = read_committed(
        spark, path, T.StructType([MANIFEST[DIVISION]]), table="marks", with_batch=True
    )
    return marks.select(F.col("_task").alias("task"), DIVISION).distinct()


def compact(spark: SparkSession, path: str, schema: T.StructType, task: str) -> int:
    """Rewrite all committed rows of a task into one attempt of few files; the batches merged.

    The rebalance hint decides the files by size. Readers see the old attempts or the new one,
    never both; the old ones stay readable until ``vacuum``.
    """
    batches = sorted(r["batch"] for r in current_commits(spark, path, task).select("batch").collect())
    if len(batches) < 2:
        return 0
    attempt = uuid.uuid4().hex
    for table, columns in ((ROWS, schema), ("marks", T.StructType([MANIFEST[DIVISION]]))):
        rows = read_committed(spark, path, columns, task, table=table, with_batch=True)
        rows.hint("rebalance").write.parquet(f"{path}/{table}/attempt={attempt}")
    commit(spark, path, task, batches, attempt, note="compacted")
    return len(batches)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the attempts that no commit points to any more; their number.

    For times when no reader is open on them and no batch is being landed.
    """
    kept = {row["attempt"] for row in current_commits(spark, path).select("attempt").collect()}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = set()
    for table in files.listStatus(root):
        for folder in files.listStatus(table.getPath()) if table.isDirectory() else []:
            name = folder.getPath().getName()
            if name.startswith("attempt=") and name.removeprefix("attempt=") not in kept:
                files.delete(folder.getPath(), True)
                gone.add(name)
    return len(gone)
