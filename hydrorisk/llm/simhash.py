"""SimHash fingerprints, linked through multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrorisk.llm.common import as_rows, id_key, original, whole_text
from hydrorisk.llm.components import components
from hydrorisk.session import settle

SEED = 42
BITS = 64
BLOCK = 1 << 16


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words, repeats included; fewer words: one shingle.

    Bytes are split where bytes 20 and 09-0D stand and A-Z are lower-cased, other
    letters are left alone.
    """
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    shingles: Iterable[bytes] = (
        map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
        if len(tokens) >= words
        else [b" ".join(tokens)]
    )
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes set it; counted block by block."""
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), BLOCK):
        part = hashes[start : start + BLOCK].view(np.uint8).reshape(-1, BITS // 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def with_fingerprints(rows: DataFrame, words: int) -> DataFrame:
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(shingle_hashes(t, words)) for t in texts], dtype="int64")

    return rows.withColumn("fingerprint", simhash("text")).drop("text")


def hamming_links(prints: DataFrame, distance: int, segments: int) -> DataFrame:
    """Pairs (a < b) of the distinct ``fingerprint`` values at most ``distance`` bits apart.

    Two values within ``distance`` agree in at least one of ``segments`` segments up to
    distance // segments bits. So one side is stored under its segments, the other
    looks up every value of a small Hamming ball around its own; the join keeps a match
    only if the complete distance holds, and only in the first segment that could find
    it, so each pair comes out once. Buckets are plain join keys: a large one is split
    by the skew join, nothing is gathered per bucket.
    """
    width = -(-BITS // segments)
    radius = distance // segments
    if radius > 1:
        raise ValueError("take more segments: balls of radius 0 or 1 are enumerated")
    low_mask = (1 << width) - 1

    def part(value, index):
        shifted = F.shiftrightunsigned(value, index * width)
        return shifted.bitwiseAND(F.lit(low_mask))

    def keyed(value: str, flips: list[int]):
        entries = []
        for index in range(segments):
            bits = min(width, BITS - index * width)
            own = part(F.col(value), index)
            for flip in (f for f in flips if f < 1 << bits):
                entries.append(
                    F.struct(F.lit(index).alias("segment"), own.bitwiseXOR(F.lit(flip)).alias("key"))
                )
        return F.array(*entries)

    ball = [0] + [1 << b for b in range(width)] * radius
    stored = prints.select(
        F.col("fingerprint").alias("b"), F.explode(keyed("fingerprint", [0])).alias("at")
    ).select("b", "at.segment", "at.key")
    asked = prints.select(
        F.col("fingerprint").alias("a"), F.explode(keyed("fingerprint", ball)).alias("at")
    ).select("a", "at.segment", "at.key")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(True)
    for index in range(segments - 1):
        first = first & (
            (F.col("s.segment") <= index) | (F.bit_count(part(apart, index)) > radius)
        )
    s, q = stored.alias("s"), asked.alias("q")
    return q.join(
        s,
        (F.col("s.segment") == F.col("q.segment"))
        & (F.col("s.key") == F.col("q.key"))
        & (F.col("a") < F.col("b"))
        & (F.bit_count(apart) <= distance)
        & first,
    ).select("a", "b")


def _labelled(distinct: DataFrame, distance: int, segments: int) -> DataFrame:
    """``distinct`` fingerprints with the ``label`` of their component."""
    # A fixed number of tasks, as each value of the small table is looked up under a ball of keys.
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = distinct.select("fingerprint").repartition(tasks, "fingerprint")
    found = components(hamming_links(prints, distance, segments))
    return distinct.join(found, F.col("fingerprint") == F.col("node"), "left").select(
        *distinct.columns, F.coalesce("least", "fingerprint").alias("label")
    )


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    distance: int = 3,
    segments: int = 2,
) -> DataFrame:
    """Per row: ``id_col``, fingerprint (16 hex digits), component_id.

    The fingerprint covers the whole text's shingles of ``words`` words. Documents whose
    fingerprints differ in at most ``distance`` bits are linked; component_id is the
    smallest id reachable. NULL and empty texts, and texts of white space, have the
    fingerprint zero and are linked like any other. Equal fingerprints are folded before
    the search, so copies make no pairs. Repeated rows stay rows of their own and share
    a component; a NULL id is never smallest unless a component has no other. An empty
    table gives an empty result; other columns are not read. Starts jobs.
    """
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    rows = settle(with_fingerprints(rows, words), "fingerprints")
    distinct = rows.groupBy("fingerprint").agg(F.min("id").alias("id"))
    labelled = _labelled(distinct, distance, segments)
    smallest = labelled.groupBy("label").agg(F.min("id").alias("component_id"))
    owners = settle(
        labelled.join(smallest, "label").select("fingerprint", "component_id"), "components"
    )
    return rows.join(owners, "fingerprint").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def drop_simhash_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    distance: int = 3,
    segments: int = 2,
) -> DataFrame:
    """The rows of ``docs``, all columns: of each component of ``simhash_components`` one stays.

    It is the row with the smallest id; a NULL id stays only where a component has no other.
    Of rows with the same id the one with the least MD5 of its text stays, and one of
    rows that repeat both. NULL, empty and blank texts are copies of each other. Texts cross
    one shuffle. Starts jobs.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.md5(whole_text(text_col).cast("binary")).alias("digest"),
        whole_text(text_col).alias("text"),
    )
    rows = settle(with_fingerprints(rows, words), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "digest")).alias("first_row")
    labelled = _labelled(rows.groupBy("fingerprint").agg(first), distance, segments)
    kept = labelled.groupBy("label").agg(F.min("first_row").alias("first_row"))
    kept = settle(kept.select(id_key("first_row.id").alias("id_key"), "first_row.digest"), "kept")
    digest = F.md5(whole_text(text_col).cast("binary"))
    stored = as_rows(docs, id_key=id_key(id_col), digest=digest)
    return original(stored.join(kept, ["id_key", "digest"]).dropDuplicates(["id_key", "digest"]))
