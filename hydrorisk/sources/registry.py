"""The division registry: id, district, province, position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hydrorisk.schemas import REGISTRY


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of registry records."""
    return spark.read.schema(REGISTRY).option("multiLine", True).json(path)
