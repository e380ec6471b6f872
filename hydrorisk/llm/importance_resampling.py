"""Target-distribution importance resampling, ranked by parallel sorting by regular sampling.

Words and short runs of words are hashed to buckets. A bucket's gain says how much more
frequent it is in the target texts than in the corpus; a document's weight is the sum of its
features' gains, looked up in one array. Gumbel noise from a digest of the id is added, and
the highest scores among the documents of enough words are drawn, which is sampling without
replacement in proportion to exp(weight / 1000).

Ranks come from parallel sorting by regular sampling. The scored rows, written once, are
sorted within each partition; every k-th row of each run is a sample; regular places among the
sorted samples are the splitters; each run is cut where they fall, and the cuts of all runs
between two splitters, a segment, are sorted by themselves. Counts of the segments before it
turn a segment's row numbers into exact ranks. Segments wholly behind the last rank drawn
are counted but neither exchanged nor sorted.

The driver holds the bucket counts (``buckets``), about ``SAMPLES`` samples and one count per
segment. Equal scores go to the smaller id; repeated rows are told apart by their place in the
written table, so a score that many rows share is split like any other.

Defined results: NULL and empty texts have no features, weight 0, and too few words to be
drawn (unless ``least_words`` is 0). NULL ids come last among equal scores, and are empty
text in the digest. Of empty tables every count is 0. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrorisk.llm.common import whole_text
from hydrorisk.session import settle

# Fixed value: a word of lower-cased UTF-8 text, that is [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Rows per sample are chosen so that the driver gets about this many samples, whatever the input.
SAMPLES = 65_536
# Segments at most, and rows a segment is to have at least.
SEGMENTS = 512
SEGMENT_ROWS = 10_000
# Buckets of features a worker remembers.
REMEMBERED = 200_000


class _Buckets(dict):
    """Bucket of each feature; forgets all when full."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature) % self.buckets
        return bucket


def _words(text: bytes) -> list[bytes]:
    # bytes.lower() changes A-Z only.
    return WORD.findall(text.lower())


def _features(words: list[bytes], longest: int) -> Iterable[bytes]:
    """Runs of 1 to ``longest`` consecutive words, repeats included."""
    runs = [words]
    for n in range(2, longest + 1):
        runs.append(map(b" ".join, zip(*[words[i:] for i in range(n)], strict=False)))
    return chain.from_iterable(runs)


def _bytes(column: str) -> Column:
    return whole_text(f"`{column}`").cast("binary")


def bucket_counts(texts: DataFrame, column: str, buckets: int, longest: int) -> DataFrame:
    """(bucket, n) over all features of all texts; a task sends one row per bucket it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = (text.as_py() for text in batch.column(0))
            met = Counter(chain.from_iterable(_features(_words(t), longest) for t in texts))
            at = np.fromiter(map(known.__getitem__, met), np.int64, len(met))
            np.add.at(counts, at, np.fromiter(met.values(), np.int64, len(met)))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some), "n": pa.array(counts[some])})

    met = texts.select(_bytes(column).alias("_text")).mapInArrow(run, "bucket bigint, n bigint")
    return met.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(
    corpus: DataFrame, target: DataFrame, column: str = "text", buckets: int = 10_000, longest: int = 1
) -> np.ndarray:
    """Gain of every bucket in thousandths, from smoothed shares in target and corpus. Two jobs."""
    counts = []
    for texts in (corpus, target):
        found = np.zeros(buckets, np.int64)
        for bucket, n in bucket_counts(texts, column, buckets, longest).collect():
            found[bucket] = n
        counts.append(found)
    s, t = (c.astype(np.float64) for c in counts)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weigh(
    docs: DataFrame, gains: np.ndarray, id_column: str = "doc_id", column: str = "text", longest: int = 1
) -> DataFrame:
    """id, n_features, n_words and weight of every document."""
    longs = ["n_features", "n_words", "weight"]
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_column].dataType),
            *[T.StructField(c, T.LongType()) for c in longs],
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(len(gains))
        for batch in batches:
            columns: list[list[int]] = [[], [], []]
            for text in batch.column(1):
                words = _words(text.as_py())
                met = Counter(_features(words, longest))
                at = np.fromiter(map(known.__getitem__, met), np.int64, len(met))
                times = np.fromiter(met.values(), np.int64, len(met))
                for values, value in zip(columns, (times.sum(), len(words), gains[at] @ times), strict=True):
                    values.append(int(value))
            arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in columns]]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", *longs])

    texts = docs.select(F.col(f"`{id_column}`").alias("id"), _bytes(column).alias("_text"))
    return texts.mapInArrow(run, schema)


def gumbel(id_column: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of SHA-256 of ``seed:id``."""
    known = F.coalesce(id_column.cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), known).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("bigint")


def _order() -> list[Column]:
    """The order of draws: best score first, then the smaller id, then the place in the table."""
    return [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("at").asc()]


def _places(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The order of a batch's rows as comparable tuples."""
    columns = (batch.column(c).to_pylist() for c in ("score", "id", "at"))
    for score, id_, at in zip(*columns, strict=True):
        yield -score, id_ is None, id_, at


def _regular_samples(runs: DataFrame, every: int) -> list[tuple]:
    """Every ``every``-th row of each sorted run, in order."""
    taken = runs.select("score", "id", "at")

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            places = np.arange((every - 1 - seen) % every, batch.num_rows, every)
            seen += batch.num_rows
            yield batch.take(pa.array(places, pa.int64()))

    rows = taken.mapInArrow(sampled, taken.schema).collect()
    return sorted((-r["score"], r["id"] is None, r["id"], r["at"]) for r in rows)


def _cut(runs: DataFrame, splitters: list[tuple]) -> DataFrame:
    """The rows of sorted runs with the ``segment`` between two splitters they lie in."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = 0
        for batch in batches:
            dealt = []
            for place in _places(batch):
                while segment < len(splitters) and place >= splitters[segment]:
                    segment += 1
                dealt.append(segment)
            yield batch.append_column("segment", pa.array(dealt, pa.int32()))

    return runs.mapInArrow(cut, T.StructType([*runs.schema.fields, T.StructField("segment", T.IntegerType())]))


def rank_highest(scored: DataFrame, drawn: int, rows: int, segments: int | None = None) -> DataFrame:
    """``scored`` (id, score, at, ...) with the exact ``rank`` of the ``drawn`` highest scores, else NULL.

    ``scored`` is a written table of ``rows`` rows whose ``at`` tells them apart. Starts jobs.
    """
    segments = segments or max(1, min(SEGMENTS, rows // SEGMENT_ROWS))
    runs = scored.sortWithinPartitions(*_order())
    samples = _regular_samples(runs, max(1, math.ceil(rows / SAMPLES))) if segments > 1 else []
    places = dict.fromkeys(len(samples) * k // segments for k in range(1, segments)) if samples else []
    dealt = settle(_cut(runs, [samples[p] for p in places]), "segments")
    counts = dict(dealt.groupBy("segment").agg(F.count(F.lit(1))).collect())
    before = [0]
    for segment in range(len(places) + 1):
        before.append(before[-1] + counts.get(segment, 0))
    reached = sum(start < drawn for start in before[:-1])
    offset = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in before]), F.col("segment") + 1)
    within = F.row_number().over(Window.partitionBy("segment").orderBy(*_order()))
    first = dealt.filter(F.col("segment") < reached).withColumn("rank", offset + within)
    first = first.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = dealt.filter(F.col("segment") >= reached).withColumn("rank", F.lit(None).cast("bigint"))
    return first.unionByName(rest).drop("segment")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
    buckets: int = 10_000,
    longest: int = 1,
    id_column: str = "doc_id",
    column: str = "text",
) -> DataFrame:
    """id, n_features, weight, score and rank of every document; only drawn ones have a rank.

    Of the documents with ``least_words`` words or more, ``percent`` (rounded down) are drawn to
    resemble the ``target`` texts. Starts jobs; the result reads tables of the open
    staging scope.
    """
    gains = bucket_gains(docs, target, column, buckets, longest)
    weighed = weigh(docs, gains, id_column, column, longest)
    scored = settle(
        weighed.select(
            "id",
            "n_features",
            "n_words",
            "weight",
            (F.col("weight") + gumbel(F.col("id"), seed)).alias("score"),
            F.monotonically_increasing_id().alias("at"),
        ),
        "scored",
    )
    enough = F.col("n_words") >= least_words
    rows = scored.filter(enough).count()
    ranked = rank_highest(scored.filter(enough), percent * rows // 100, rows)
    short = scored.filter(~enough).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(short).select(
        F.col("id").alias(id_column), "n_features", "weight", "score", "rank"
    )


def drawn_documents(docs: DataFrame, ranks: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The drawn documents, all their columns; ``ranks`` is what ``resample`` returned."""
    drawn = ranks.filter(F.col("rank").isNotNull()).select(F.col(f"`{id_column}`").alias("_drawn")).distinct()
    same = F.col(f"`{id_column}`").eqNullSafe(F.col("_drawn"))
    return docs.join(drawn, same, "left_semi")
