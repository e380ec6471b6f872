"""Corpus pipeline: toxicity, exact dedup, near dedup, decontamination, packing.

Each stage reads what its predecessor kept, from Parquet. Every stage but the last returns
the columns of ``documents``; the last one returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hydrorisk.llm.common import table
from hydrorisk.llm.decontamination import build_index, drop_contaminated
from hydrorisk.llm.exact_dedup import drop_exact_copies
from hydrorisk.llm.packing import pack
from hydrorisk.llm.simhash import drop_simhash_copies
from hydrorisk.llm.toxicity import drop_toxic, fit_toxicity
from hydrorisk.session import shared_path, staging

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Documents scoring this or more are rejected.
TOXIC_FROM = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance model does not call toxic.

    The model learns from all labelled documents of the corpus; with no labels, or labels
    of one class only, nothing is rejected.
    """
    labels = table(spark, sf_dir, "labels")
    model = fit_toxicity(table(spark, sf_dir, "documents"), labels)
    return drop_toxic(docs, model, TOXIC_FROM)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of equal texts (A-Z lower-cased)."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of those linked by fingerprints of 3-word shingles, 3 bits apart."""
    return drop_simhash_copies(docs, words=3, distance=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, build_index(table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their place in sequences."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Models, fingerprints and tokenizers are beyond SQL; tests check planted cases, and near_dedup
# against brute force on its own input.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and reread.

    What a stage stages for itself goes once its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        with staging(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
