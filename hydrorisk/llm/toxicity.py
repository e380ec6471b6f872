"""Toxicity by compression distance: two zstandard dictionaries, calibrated window lengths."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from heapq import nlargest

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrorisk.llm.common import as_rows, original, whole_text
from hydrorisk.llm.token_counts import portions

WORD = re.compile(r"\w+")
# Longest part of a word in one window; longer words give several.
PART = 40
# Both dictionaries hold this lead-in. zstandard stores a very short block raw; with a lead-in that
# always matches, each window is compressed and its length tells how much of it matched.
LEAD = bytes(range(1, 17))
# Distinct windows that a task remembers; beyond it the memory is emptied.
MEMORY = 200_000
TOP = 3


def windows(text: str) -> set[bytes]:
    """Distinct windows of a whole text: its words, lower-cased, with a space on either side."""
    found = set()
    for word in set(WORD.findall(text.lower())):
        for at in range(0, len(word), PART):
            found.add(LEAD + b" " + word[at : at + PART].encode("utf-8", "replace") + b" ")
    return found


@lru_cache(maxsize=8)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    parameters = zstandard.ZstdCompressionParameters.from_level(
        19,
        dict_size=len(content),
        source_size=len(LEAD) + PART,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


def _lengths(compressor: zstandard.ZstdCompressor, parts: list[bytes]) -> list[int]:
    """Compressed length of each window, all in one call."""
    if not parts:
        return []
    sizes = np.fromiter(map(len, parts), np.uint64, len(parts))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype("<u8")
    segments = np.stack([starts, sizes], 1).astype("<u8").tobytes()
    packed = zstandard.BufferWithSegments(b"".join(parts), segments)
    return [len(x) for x in compressor.multi_compress_to_buffer(packed, threads=1)]


@dataclass
class Dictionaries:
    """The content of the two trained dictionaries."""

    toxic: bytes
    ordinary: bytes

    def cells(self, parts: list[bytes]) -> list[tuple[int, int, int]]:
        """(bytes, length with the ordinary, length with the toxic dictionary) of each window."""
        ordinary = _lengths(_compressor(self.ordinary), parts)
        toxic = _lengths(_compressor(self.toxic), parts)
        return list(zip(map(len, parts), ordinary, toxic, strict=True))


def _excess(count: int, n: int, other: int, m: int) -> float:
    """Likelihood ratio of a window's document share in a class over the other; 0 if it is smaller."""
    if not count or count * m <= other * n:
        return 0.0

    def log_likelihood(k: int, of: int, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((of - k) * math.log(1 - p) if of > k else 0.0)

    both = (count + other) / (n + m)
    own = log_likelihood(count, n, count / n) + log_likelihood(other, m, other / m if m else 0.0)
    return 2 * (own - log_likelihood(count, n, both) - log_likelihood(other, m, both))


def train_dictionaries(
    toxic: list[set[bytes]], ordinary: list[set[bytes]], size: int = 32768
) -> Dictionaries:
    """Separate dictionaries from the windows of toxic and of ordinary documents.

    The toxic one takes the windows that are more frequent in toxic documents by a
    likelihood ratio no chance window reaches; the ordinary one the windows found in
    most ordinary documents. The most telling windows come last, where offsets are short.
    """
    in_toxic = Counter(w for doc in toxic for w in doc)
    in_ordinary = Counter(w for doc in ordinary for w in doc)
    n, m = len(toxic), len(ordinary)
    beyond_chance = 2 * math.log(max(2, len(in_toxic)))
    telling = {w: _excess(c, n, in_ordinary[w], m) for w, c in in_toxic.items() if c > 1}
    telling = {w: x for w, x in telling.items() if x > beyond_chance}

    def content(ranked: list[bytes]) -> bytes:
        kept, total = [], len(LEAD)
        for window in ranked:
            total += len(window)
            if total > size:
                break
            kept.append(window)
        return b"".join(reversed(kept)) + LEAD

    return Dictionaries(
        content(sorted(telling, key=lambda w: (-telling[w], w))),
        content([w for w, _ in sorted(in_ordinary.items(), key=lambda x: (-x[1], x[0]))]),
    )


@dataclass
class ToxicityModel:
    """Dictionaries, log-odds of window cells, and a logistic curve over a text's top cells."""

    dictionaries: Dictionaries
    odds: dict[tuple[int, int, int], float]
    weights: list[float]
    known: dict[bytes, float] = field(default_factory=dict, repr=False)
    memory: int = MEMORY

    def scores(self, texts: Iterable[str]) -> list[float]:
        """The curve's value at the log-odds of each text's most toxic windows.

        All windows of a text count; each distinct one is compressed once.
        """
        result, known = [], self.known
        for portion in portions(texts):
            own = [windows(text) for text in portion]
            if len(known) > self.memory:
                known.clear()
            new = list({w for some in own for w in some if w not in known})
            cells = self.dictionaries.cells(new)
            known.update(zip(new, (self.odds.get(c, 0.0) for c in cells), strict=True))
            result += [_logistic(self.weights, _top(map(known.__getitem__, some))) for some in own]
        return result


def _top(values: Iterable[float]) -> list[float]:
    top = nlargest(TOP, values)
    return top + [0.0] * (TOP - len(top))


def _logistic(weights: list[float], features: list[float]) -> float:
    value = weights[0] + sum(w * x for w, x in zip(weights[1:], features, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, value))))


def _cell_odds(toxic: list[set[tuple]], ordinary: list[set[tuple]]) -> dict[tuple, float]:
    """Log-odds of a cell: in how many toxic and ordinary documents it has windows."""
    seen = [Counter(c for doc in docs for c in doc) for docs in (toxic, ordinary)]
    n, m = len(toxic) + 1, len(ordinary) + 1
    odds = {}
    for cell in seen[0] | seen[1]:
        a, b = seen[0][cell], seen[1][cell]
        # Cells met in few documents are drawn to zero.
        odds[cell] = (a + b) / (a + b + 2) * math.log((a + 0.5) / n / ((b + 0.5) / m))
    return odds


def _fit_logistic(rows: list[list[float]], labels: list[int], ridge: float = 0.1) -> list[float]:
    """Weights of a ridge logistic regression by Newton's method; features may only speak for toxic."""
    x = np.column_stack([np.ones(len(rows)), np.asarray(rows, float).reshape(-1, TOP)])
    y = np.asarray(labels, float)
    weights, penalty = np.zeros(TOP + 1), np.diag([1e-3] + [ridge] * TOP)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - y) + penalty @ weights
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, gradient)
        weights = weights - np.clip(step, -2, 2)
        weights[1:] = np.maximum(weights[1:], 0)
    return [float(w) for w in weights]


def train_model(examples: list[tuple[str, int]], size: int = 32768) -> ToxicityModel:
    """A model of labelled texts (text, 1 for toxic).

    Equal texts count once. Dictionaries trained on one half are calibrated on the other,
    both ways, so no window is judged by a dictionary that holds it by chance; the final
    dictionaries take both halves and the mean of the two calibrations. With one class
    only (or no text) every score is the smoothed share of toxic examples.
    """
    unique = list(dict(examples).items())
    pool: dict = {}  # one object for equal windows and cells: they are most of the memory
    prepared = [
        (
            zlib.crc32(t.encode("utf-8", "replace")) & 1,
            {pool.setdefault(w, w) for w in windows(t)},
            y,
        )
        for t, y in unique
    ]

    def docs(half: int | None, label: int) -> list[set[bytes]]:
        return [w for h, w, y in prepared if y == label and half in (None, h)]

    dictionaries = train_dictionaries(docs(None, 1), docs(None, 0), size)
    labels = [y for _, _, y in prepared]
    if len(set(labels)) < 2:
        share = (sum(labels) + 1) / (len(labels) + 2)
        return ToxicityModel(dictionaries, {}, [math.log(share / (1 - share))] + [0.0] * TOP)
    odds: list[dict] = []
    rows, targets = [], []
    for half in (0, 1):
        part = train_dictionaries(docs(half, 1), docs(half, 0), size)
        other = [docs(1 - half, label) for label in (0, 1)]
        every = list(set().union(*other[0], *other[1]))
        cells = (pool.setdefault(c, c) for c in part.cells(every))
        cell = dict(zip(every, cells, strict=True))
        table = _cell_odds(*[[{cell[w] for w in d} for d in other[label]] for label in (1, 0)])
        odds.append(table)
        for label in (0, 1):
            for doc in other[label]:
                rows.append(_top(table.get(cell[w], 0.0) for w in doc))
                targets.append(label)
    mean = {c: (odds[0].get(c, 0.0) + odds[1].get(c, 0.0)) / 2 for c in odds[0] | odds[1]}
    return ToxicityModel(dictionaries, mean, _fit_logistic(rows, targets))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    most_toxic: int = 2000,
    most_ordinary: int = 4000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> ToxicityModel:
    """A model from a bounded sample of labelled rows, drawn by a hash of their ids.

    At most ``most_toxic`` and ``most_ordinary`` rows reach the driver, whatever the
    input's size; ``usable``, a condition on ``id_col``, holds rows back. Labels that
    are NULL or neither 0 nor 1 are left out.
    """
    if usable is not None:
        labels = labels.filter(usable)
    examples: list[tuple[str, int]] = []
    for label, most in ((1, most_toxic), (0, most_ordinary)):
        drawn = (
            labels.filter(F.col(label_col) == label)
            .select(F.col(id_col).alias("id"))
            .distinct()
            .orderBy(F.xxhash64("id"), "id")
            .limit(most)
        )
        texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
        # The drawn ids are at most ``most`` rows.
        found = texts.join(F.broadcast(drawn), "id").orderBy(F.xxhash64("id"), "text").limit(most)
        examples += [(row.text, label) for row in found.select("text").collect()]
    return train_model(examples)


def _scorer(docs: DataFrame, model: ToxicityModel):
    """The model as a column function; it is bounded by the dictionaries' size and sent once."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = replace(sent.value, known={})  # its memory of windows ends with the task
        for texts in batches:
            yield pa.array(own.scores(texts.to_pylist()), pa.float64())

    return scored


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, text_col: str = "text", name: str = "score"
) -> DataFrame:
    """All columns of ``docs`` plus ``name``, the probability that a text is toxic.

    Reads the whole text and nothing else. NULL and empty texts have no windows and get
    the score of a text without a toxic one. Repeated rows score alike, an empty table
    gives no rows, a column called ``name`` is replaced. No shuffle: every task compresses each
    distinct window once, within a bounded memory.
    """
    rows = as_rows(docs, value=_scorer(docs, model)(whole_text(text_col)))
    plain = [c for c in docs.columns if c != name]
    return rows.select(*[F.col("row").getField(c).alias(c) for c in plain], F.col("value").alias(name))


def drop_toxic(
    docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``.

    A model of one class, or of no examples, tells no texts apart and drops nothing.
    """
    if not model.odds:
        return docs
    rows = as_rows(docs, value=_scorer(docs, model)(whole_text(text_col)))
    return original(rows.filter(F.col("value") < threshold))
