"""One thin query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrorisk.llm.common import table
from hydrorisk.llm.conversation_repair import (
    audit_conversations,
    damage_conversations,
    repaired_digests,
)
from hydrorisk.llm.decontamination import build_index, find_leaks
from hydrorisk.llm.exact_dedup import exact_dedup
from hydrorisk.llm.importance_resampling import resample
from hydrorisk.llm.line_dedup import drop_frequent_lines
from hydrorisk.llm.main_text import extract_main_text
from hydrorisk.llm.packing import pack
from hydrorisk.llm.register import LLM_ORACLES, LLM_QUERIES, query
from hydrorisk.llm.sharding import shard_by_bytes
from hydrorisk.llm.simhash import simhash_components
from hydrorisk.llm.substring_dedup import repeated_passages
from hydrorisk.llm.token_counts import token_counts
from hydrorisk.llm.toxicity import fit_toxicity, score_toxicity
from hydrorisk.llm.url_templates import judge_urls

__all__ = ["LLM_ORACLES", "LLM_QUERIES"]

EXACT_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""


@query()
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))


@query()
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component: 3-word shingles, 3 bits."""
    return simhash_components(table(spark, sf_dir, "documents"), words=3, distance=3)


LINES_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (
  SELECT key, 1 AS hit FROM k WHERE key <> ''
  GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hit) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (hit IS NULL), ''))
         AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id
"""


@query(LINES_SQL)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines found in ten documents or more."""
    kept = drop_frequent_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


# (action, host, path): fixed values of the query.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


@query()
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by rule, or else by its template."""
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


@query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by a model of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), usable=fold != 1)
    return score_toxicity(docs, model).select(
        "doc_id",
        (fold == 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


@query(EXACT_SQL)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy of it that stays."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


@query()
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal bytes."""
    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)


@query()
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item that a document holds."""
    index = build_index(table(spark, sf_dir, "benchmark"))
    return find_leaks(table(spark, sf_dir, "documents"), index)


@query()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents"))


@query()
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that are found again in another document."""
    return repeated_passages(table(spark, sf_dir, "documents"), words=50, similarity=0.8)


@query()
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = extract_main_text(pages).select("page_id", "url", "text")
    return texts.withColumn("n_chars", F.char_length("text").cast("bigint"))


@query()
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and score, and the rank of the tenth drawn to resemble the benchmark."""
    docs, target = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return resample(docs, target, percent=10, least_words=20, seed=2024, buckets=10_000, longest=1)


@query()
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule, with the cheapest edits that make it legal again."""
    damaged = damage_conversations(table(spark, sf_dir, "conversations"))
    present = ~F.col("dropped")
    audits = audit_conversations(damaged, present=present)
    return repaired_digests(damaged, audits, present=present)
