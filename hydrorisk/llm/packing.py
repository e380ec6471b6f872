"""Documents packed into sequences: repeat counts of length combinations by least squares."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrorisk.llm.common import whole_text
from hydrorisk.llm.token_counts import (
    LETTERS,
    NUMBERS,
    SETTLED,
    added_tokens,
    load_tokenizer,
    portions,
)
from hydrorisk.operators.windows import positions
from hydrorisk.session import settle

# Split rule of the word tokenizer, after lower-casing: fixed by its file format.
WORD_LEVEL = re.compile(
    rf"[{LETTERS}]+|[{NUMBERS}]|'(?:[stmd]|re|ve|ll)|[^\s{LETTERS}{NUMBERS}]+"
)

# Bytes without a sign of their own, in the signs that byte-level files write them as.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_HIDDEN = (b for b in range(0x100) if b not in _SHOWN)
BYTE_SIGNS = {b: chr(0x100 + n) for n, b in enumerate(_HIDDEN)}

# Distinct words that a worker remembers from task to task; beyond it the memory is emptied.
MEMORY = 600_000
# Parts in which the pieces of one length are ranked.
BLOCKS = 1024


class WordIds:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, word by word from a memory.

    The library's model encodes each distinct word once. Texts with characters that pattern
    engines may class differently go to the library whole.
    """

    def __init__(self, file: str, memory: int = MEMORY):
        self.tokenizer = load_tokenizer(file)
        self.model = self.tokenizer.model
        self.added = list(added_tokens(self.tokenizer))
        self.words: dict[str, bytes] = {}
        self.memory = memory

    def split(self, text: str) -> list[str] | None:
        if not SETTLED.fullmatch(text) or any(a in text for a in self.added):
            return None
        return WORD_LEVEL.findall(text.lower())

    def learn(self, words: Iterable[str]) -> None:
        """Know every one of ``words``; the memory is emptied first if it has grown too large.

        Split words in lower case need nothing of the library but its model, to which they go
        by the signs of their bytes.
        """
        if len(self.words) > self.memory:
            self.words.clear()
        new = list(set(words).difference(self.words))
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            signs = [
                w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_SIGNS) for w in part
            ]
            pieces = [self.model.tokenize(word) for word in signs]
            data = np.asarray([p.id for word in pieces for p in word], "<u4").tobytes()
            cuts = [0, *np.cumsum([4 * len(word) for word in pieces]).tolist()]
            self.words.update(zip(part, (data[a:b] for a, b in pairwise(cuts)), strict=True))

    def of(self, texts: Iterable[str]) -> Iterator[bytes]:
        for portion in portions(texts):
            split = [self.split(text) for text in portion]
            self.learn(set().union(*[words for words in split if words]))
            known = self.words
            for text, words in zip(portion, split, strict=True):
                if words is not None:
                    yield b"".join(map(known.__getitem__, words))
                else:
                    encoded = self.tokenizer.encode(text, add_special_tokens=False)
                    yield np.asarray(encoded.ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def _encoder(file: str) -> WordIds:
    return WordIds(file)


def cut_pieces(
    docs: DataFrame,
    window: int,
    end_id: int | None,
    tokenizer: str,
    id_col: str,
    text_col: str,
    with_ids: bool,
) -> DataFrame:
    """(id, start, length, crc, doc_tokens[, ids]) of full windows and one remainder per row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        for batch in batches:
            owner, start, length, crc, total, ids = [], [], [], [], [], []
            for row, data in enumerate(encoder.of(batch.column("text").to_pylist())):
                data += end
                for at in range(0, len(data), 4 * window):
                    piece = data[at : at + 4 * window]
                    owner.append(row)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(data) // 4)
                    if with_ids:
                        ids.append(piece)
            columns = [
                batch.column("id").take(pa.array(owner, pa.int64())),
                *(pa.array(x, pa.int64()) for x in (start, length, crc, total)),
            ]
            names = ["id", "start", "length", "crc", "doc_tokens"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start bigint, length bigint, crc bigint, doc_tokens bigint"
    return rows.mapInArrow(cut, schema + (", ids binary" if with_ids else ""))


def combinations(present: list[int], window: int) -> np.ndarray:
    """Combinations of two or three present lengths that fill the window, 0 for no third.

    All pairs; and triples whose smallest part is one of the lengths nearest to a
    geometric row, so their number stays at a small multiple of the window.
    """
    have = np.zeros(window + 1, bool)
    have[present] = True
    large = np.arange(1, window)
    pairs = [(a, window - a, 0) for a in large if a <= window - a and have[a] and have[window - a]]
    triples = []
    marks = np.unique(np.round(np.geomspace(1, window / 3, 24)).astype(int))
    lengths = np.asarray(sorted(x for x in present if x < window), int)
    smallest = {int(lengths[np.abs(lengths - m).argmin()]) for m in marks} if len(lengths) else set()
    for a in sorted(smallest):
        b = np.arange(a, (window - a) // 2 + 1)
        fits = b[have[b] & have[window - a - b]]
        triples += [(a, int(x), window - a - int(x)) for x in fits]
    return np.asarray(pairs + triples, int).reshape(-1, 3)


def repeat_counts(parts: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x that minimises |A x - histogram|², A counting the lengths in each combination.

    Accelerated projected gradient; A has three entries a row, so it is never formed.
    """
    x = np.zeros(len(parts))
    if not len(parts):
        return x
    wanted = histogram.astype(float)
    wanted[0] = 0
    used = parts > 0

    def lengths_of(v: np.ndarray) -> np.ndarray:
        return np.bincount(parts[used], np.repeat(v, used.sum(1)), len(wanted))

    # The largest column times the largest row sum bounds the curvature.
    degree = np.bincount(parts[used], minlength=len(wanted)).astype(float)
    bound = 3 * max(1.0, degree.max())
    momentum, look = 1.0, x
    for _ in range(rounds):
        residual = lengths_of(look) - wanted
        residual[0] = 0
        step = np.maximum(0, look - residual[parts].sum(1) / bound)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look = step + (momentum - 1) / following * (step - x)
        x, momentum = step, following
    return x


def packing_plan(histogram: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences): uses every counted piece once.

    Repeat counts are rounded and held to the pieces that are there; what is left is
    packed greedily, longest piece first, each time with the longest that still fits.
    Works on lengths only, so its cost depends on the window and not on the corpus.
    """
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], times: int) -> None:
        if times > 0:
            for length in pattern:
                left[length] -= times
            plan.append((pattern, int(times)))

    take((window,), int(left[window]))
    parts = combinations([int(i) for i in np.flatnonzero(left)], window)
    solved = np.rint(repeat_counts(parts, left)).astype(np.int64)
    for index in np.argsort(-solved, kind="stable"):
        if solved[index] <= 0:
            break
        pattern = tuple(int(p) for p in parts[index] if p)
        need = Counter(pattern)
        take(pattern, min(int(solved[index]), *(left[p] // n for p, n in need.items())))
    while left.any():
        room, need = window, Counter()
        for length in np.flatnonzero(left)[::-1]:
            fits = min(room // length, int(left[length]))
            if fits:
                need[int(length)] = int(fits)
                room -= fits * length
            if not room:
                break
        take(tuple(need.elements()), min(left[p] // n for p, n in need.items()))
    return plan


def pack(
    docs: DataFrame,
    window: int = 2048,
    end_id: int | None = 1,
    tokenizer: str = "word_bpe_49k.json",
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    A document is its ids (no special tokens added) and then ``end_id``, so NULL and empty
    texts are one piece of one id (of none at all without ``end_id``). Documents longer
    than the window give full windows and one remainder. Sequences hold at most
    ``window`` ids; offsets in a sequence are gapless from 0 and sequence ids are
    numbered from 0. The only thing gathered is the histogram of piece lengths, at most
    ``window`` rows for any input; pieces find their place by rank within their length,
    ranked block by block, so a length that most pieces share is no single task. Repeated
    rows and NULL ids are packed as documents of their own; an empty table gives no rows;
    other columns are not read. Starts jobs: pieces are stored in the shared folder,
    with their ids only if ``with_ids`` asks for them.
    """
    pieces = settle(
        cut_pieces(docs, window, end_id, tokenizer, id_col, text_col, with_ids), "pieces"
    )
    spark = docs.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    places, sequence = [], 0
    ranks: Counter[int] = Counter()
    for pattern, times in packing_plan(histogram, window):
        offset = 0
        for length in pattern:
            places.append((length, ranks[length], ranks[length] + times, sequence, offset))
            ranks[length] += times
            offset += length
        sequence += times
    # Its size depends on the window alone: combinations of lengths, not pieces.
    plan = spark.createDataFrame(
        places, "length bigint, low bigint, high bigint, first bigint, offset bigint"
    )
    ranked = positions(
        pieces.withColumn("block", F.pmod(F.xxhash64("id", "start", "crc"), F.lit(BLOCKS))),
        ["length"],
        "block",
        ["id", "start", "crc"],
        "rank",
    ).withColumn("rank", F.col("rank") - 1)
    return (
        ranked.join(F.broadcast(plan), "length")
        .filter("rank >= low AND rank < high")
        .select(
            F.col("id").alias(id_col),
            "start",
            "length",
            F.col("crc").alias("ids_crc32"),
            "doc_tokens",
            (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"),
            "offset",
            *(["ids"] if with_ids else []),
        )
    )
