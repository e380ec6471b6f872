"""Session defaults and the shared folder for cut lineage and staged tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "hydrorisk", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library counts on; extra settings by keyword."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for a one-process local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hydrorisk-"))
    return spark.sparkContext.getCheckpointDir()


_scope: ContextVar[str | None] = ContextVar("staging", default=None)


@contextmanager
def staging(spark: SparkSession) -> Iterator[str]:
    """Owner of what is staged inside: its folder goes when the scope ends.

    Frames that read staged tables are to be used inside; write results elsewhere.
    Without a scope staged tables stay until the shared folder is emptied.
    """
    folder = shared_path(spark, "staging")
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder, or below the open staging scope."""
    root = _scope.get() or shared_root(spark).rstrip("/")
    return f"{root}/hydrorisk-{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a later step reads the same rows more than once: the upstream
    work runs once, each reader prunes columns on its own, and a lost executor
    costs a re-read instead of a recomputation.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
