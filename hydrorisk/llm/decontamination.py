"""Benchmark decontamination: BM25 over test items, block-max WAND, question and answer overlap."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from hydrorisk.llm.common import as_rows, original, whole_text
from hydrorisk.session import settle

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
END = 1 << 60
# Passages of a text that are bounded together.
PASSAGES = 256


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[str, str]:
    """A test item without columns of its own for them: all but the last sentence, and that one.

    An item of one sentence is its own question and answer.
    """
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text) if WORD.search(p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def item_words(question: str, answer: str) -> list[str]:
    """The words of an item, repeats included."""
    return words_of(question if question == answer else f"{question} {answer}")


def shingles(words: list[str], n: int) -> set[tuple[str, ...]]:
    """Word n-grams; a shorter text is one gram."""
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def overlap(wanted: set[tuple[str, ...]], words: list[str]) -> float:
    """Share of the grams that the words hold; 1 for no grams."""
    if not wanted:
        return 1.0
    n = len(next(iter(wanted)))
    have = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    return len(wanted & have) / len(wanted)


@dataclass
class Posting:
    """A term's items in ascending order, their weights, and the largest weight of each block."""

    items: list[int]
    weights: list[float]
    block_max: dict[int, float]


class ItemIndex:
    """Inverted index of test items; a weight is a BM25 share of the item's own score.

    So a passage that holds all of an item's words scores 1 for it, whatever the item's length.
    """

    def __init__(
        self,
        items: list[tuple],
        block: int = 8,
        kind: str = "bigint",
        corpus: tuple[int, float, dict[str, int]] | None = None,
    ):
        """``corpus`` (items, mean length, items per term) is that of the whole set, for a part of it."""
        self.block, self.kind = block, kind
        self.ids, self.question, self.answer = [], [], []
        bags = []
        for item, question, answer in items:
            bag = Counter(item_words(question, answer))
            if bag:
                bags.append(bag)
                self.ids.append(item)
                self.question.append(shingles(words_of(question), 5))
                self.answer.append(shingles(words_of(answer), 3))
        lengths = [bag.total() for bag in bags]
        self.longest = max(lengths, default=1)
        count, mean = len(bags), sum(lengths) / max(1, len(lengths))
        found: dict[str, int] = Counter(term for bag in bags for term in bag)
        if corpus is not None:
            count, mean, found = corpus
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for number, (bag, length) in enumerate(zip(bags, lengths, strict=True)):
            norm = K1 * (1 - B + B * length / mean)
            weight = {
                t: math.log(1 + (count - found[t] + 0.5) / (found[t] + 0.5)) * n * (K1 + 1) / (n + norm)
                for t, n in bag.items()
            }
            whole = sum(weight.values())
            for term, value in weight.items():
                postings[term].append((number, value / whole))
        self.number = {term: i for i, term in enumerate(postings)}
        self.postings = []
        for entries in postings.values():
            blocks: dict[int, float] = {}
            for item, weight in entries:
                blocks[item // block] = max(weight, blocks.get(item // block, 0.0))
            self.postings.append(Posting([i for i, _ in entries], [w for _, w in entries], blocks))
        # The same block maxima, term after term, to bound many passages at once.
        self.blocks = -(-len(bags) // block)
        sizes = [len(p.block_max) for p in self.postings]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.block_ids = np.fromiter((b for p in self.postings for b in p.block_max), np.int64)
        self.block_most = np.fromiter(
            (m for p in self.postings for m in p.block_max.values()), np.float64
        )

    def promising(
        self, passage: np.ndarray, term: np.ndarray, passages: int, threshold: float
    ) -> list[tuple[int, int]]:
        """(passage, block) where the block maxima of the passage's distinct terms reach the threshold.

        ``passage`` and ``term`` are distinct pairs; one sum of block maxima per passage and block.
        """
        if not len(term):
            return []
        sizes = self.first[term + 1] - self.first[term]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.first[term] - (ends - sizes), sizes)
        cell = np.repeat(passage * self.blocks, sizes) + self.block_ids[at]
        bounds = np.bincount(cell, self.block_most[at], passages * self.blocks)
        return [divmod(c, self.blocks) for c in np.flatnonzero(bounds >= threshold - 1e-9).tolist()]

    def above(self, terms: Iterable[int], threshold: float, block: int) -> list[tuple[int, float]]:
        """Every item (number, score) of a block that reaches ``threshold`` for the distinct terms.

        WAND: cursors ordered by item; the pivot is the first at which the terms' largest
        weights in the block could reach the threshold. Items before it are leapt over.
        """
        end = (block + 1) * self.block
        cursors = []
        for term in terms:
            posting = self.postings[term]
            if block in posting.block_max:
                at = bisect_left(posting.items, block * self.block)
                cursors.append([posting.items[at], at, posting, posting.block_max[block]])
        found = []
        while True:
            cursors = sorted((c for c in cursors if c[0] < end), key=itemgetter(0))
            bound = 0.0
            for cursor in cursors:
                bound += cursor[3]
                if bound >= threshold - 1e-12:
                    item = cursor[0]
                    break
            else:
                return found
            score = 0.0
            for cursor in cursors:
                if cursor[0] < item:
                    _seek(cursor, item)
                if cursor[0] == item:
                    score += cursor[2].weights[cursor[1]]
                    _seek(cursor, item + 1)
            if score >= threshold - 1e-12:
                found.append((item, score))

    def leaks(self, text: str, score: float, question: float, answer: float) -> list[tuple]:
        """(item, score, question overlap, answer overlap, first word of the passage), best passage each.

        Passages are windows of twice the longest item, one such length apart, so any
        occurrence of an item lies whole in one of them. Blocks whose maxima stay below the
        threshold for a passage are passed over without a look at their items.
        """
        words = words_of(text)
        none = len(self.postings)
        number = self.number
        terms = np.fromiter((number.get(w, none) for w in words), np.int64, len(words))
        known = np.flatnonzero(terms < none)
        step = self.longest
        last = max(0, -(-(len(words) - step) // step) - 1)
        best: dict[int, tuple] = {}
        for low in range(0, last + 1, PASSAGES):
            count = min(PASSAGES, last + 1 - low)
            part = known[(known >= low * step) & (known < (low + count + 1) * step)]
            own = part // step - low
            pairs = np.concatenate([own, own - 1]) * none + np.tile(terms[part], 2)
            # A word lies in the passage that starts in its stretch and in the one before.
            inside = np.concatenate([own < count, own >= 1])
            passage, term = np.divmod(np.unique(pairs[inside]), max(1, none))
            of: dict[int, list[int]] = {}
            for at, block in self.promising(passage, term, count, score):
                if at not in of:
                    of[at] = term[passage == at].tolist()
                start = (low + at) * step
                for item, value in self.above(of[at], score, block):
                    near = words[start : start + 2 * step]
                    q, a = overlap(self.question[item], near), overlap(self.answer[item], near)
                    if q >= question and a >= answer:
                        entry = (value, q, a, -start)
                        best[item] = max(best.get(item, entry), entry)
        return [(self.ids[i], v, q, a, -s) for i, (v, q, a, s) in sorted(best.items())]


def _seek(cursor: list, item: int) -> None:
    """Move a cursor to its first item at or after ``item``."""
    items = cursor[2].items
    cursor[1] = bisect_left(items, item, cursor[1])
    cursor[0] = items[cursor[1]] if cursor[1] < len(items) else END


@F.pandas_udf(T.ArrayType(T.StringType()))
def _item_words(questions: pd.Series, answers: pd.Series) -> pd.Series:
    """All words of items with a question and an answer of their own."""
    return pd.Series([item_words(*pair) for pair in zip(questions, answers, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _text_words(texts: pd.Series) -> pd.Series:
    """All words of items that are one text."""
    return pd.Series([item_words(*question_and_answer(text)) for text in texts])


def build_index(
    benchmark: DataFrame,
    item_col: str = "item_id",
    text_col: str = "text",
    question_col: str | None = None,
    answer_col: str | None = None,
    most_bytes: int = 64 << 20,
) -> list[ItemIndex]:
    """The index of a test set, in as many parts as keep each below about ``most_bytes`` of text.

    A part is what every task gets at a time; weights are those of the whole set, so the
    number of parts changes no result. The driver holds one part's texts at a time, and all
    parts' postings. Items without a word, NULL texts among them, match nothing; an item
    without an id is left out. Ids may be of any type.
    """
    items = benchmark.filter(F.col(item_col).isNotNull())
    kind = benchmark.schema[item_col].dataType.simpleString()
    columns = [whole_text(c) for c in ([question_col, answer_col] if question_col else [text_col])]
    size = items.agg(F.sum(F.octet_length(F.concat(*columns)))).first()[0] or 0
    parts = max(1, math.ceil(size / most_bytes))

    def listed(rows: DataFrame) -> list[tuple]:
        found = rows.select(item_col, *columns).collect()
        if question_col:
            return sorted({tuple(row) for row in found})
        return sorted({(item, *question_and_answer(text)) for item, text in found})

    if parts == 1:
        return [ItemIndex(listed(items), kind=kind)]
    part = F.pmod(F.xxhash64(F.col(item_col).cast("string")), F.lit(parts))
    distinct = items.select(F.col(item_col), *[c.alias(f"_{i}") for i, c in enumerate(columns)]).distinct()
    words = (_item_words if question_col else _text_words)(*[f"_{i}" for i in range(len(columns))])
    words = distinct.select(part.alias("part"), words.alias("words")).filter(F.size("words") > 0)
    words = settle(words, "item-words")
    count, mean = words.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
    own = words.select("part", F.explode(F.array_distinct("words")).alias("term"))
    found = settle(own.groupBy("term").agg(F.count(F.lit(1)).alias("items")), "item-terms")
    indexes = []
    for number in range(parts):
        terms = own.filter(F.col("part") == number).select("term").distinct()
        known = dict(found.join(terms, "term").collect())
        rows = listed(items.filter(part == number))
        indexes.append(ItemIndex(rows, kind=kind, corpus=(count, mean or 0.0, known)))
    return indexes


def find_leaks(
    docs: DataFrame,
    index: list[ItemIndex],
    id_col: str = "doc_id",
    text_col: str = "text",
    score: float = 0.5,
    question: float = 0.5,
    answer: float = 0.5,
) -> DataFrame:
    """Per document and test item found in it: ``id_col``, item_id, score, question_overlap,
    answer_overlap, passage_start (in words).

    Every passage of every whole text is a query; an item is reported where its BM25 share
    reaches ``score`` and the passage holds at least ``question`` of the question's
    five-word and ``answer`` of the answer's three-word grams. NULL and empty texts hold no
    item. Repeated rows report the same again; NULL ids are kept; an empty table gives no
    rows, as does an index without items. Other columns are not read. No shuffle; texts are
    read once per part of the index.
    """
    found = [_find_in(docs, part, id_col, text_col, score, question, answer) for part in index]
    return reduce(DataFrame.unionByName, found)


def _find_in(
    docs: DataFrame, index: ItemIndex, id_col: str, text_col: str, score: float, question: float, answer: float
) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)
    item_kind = to_arrow_type(T.StructType.fromDDL(f"id {index.kind}")[0].dataType)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            owner, found = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                leaks = own.leaks(text, score, question, answer)
                owner += [row] * len(leaks)
                found += leaks
            columns = list(zip(*found, strict=True)) or [()] * 5
            kinds = [item_kind, pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(owner, pa.int64())),
                    *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)),
                ],
                ["id", "item_id", "score", "question_overlap", "answer_overlap", "passage_start"],
            )

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        search,
        f"id {kind}, item_id {index.kind}, score double, question_overlap double,"
        " answer_overlap double, passage_start bigint",
    ).withColumnRenamed("id", id_col)


def drop_contaminated(
    docs: DataFrame, index: list[ItemIndex], id_col: str = "doc_id", text_col: str = "text", **limits: float
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no test item."""
    for part in index:
        docs = _without(docs, part, text_col, limits)
    return docs


def _without(docs: DataFrame, index: ItemIndex, text_col: str, limits: dict[str, float]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)
    limits = {"score": 0.5, "question": 0.5, "answer": 0.5, **limits}

    @F.arrow_udf("boolean")
    def leaked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        for texts in batches:
            yield pa.array([bool(own.leaks(t, **limits)) for t in texts.to_pylist()], pa.bool_())

    rows = as_rows(docs, leaked=leaked(whole_text(text_col)))
    return original(rows.filter(~F.col("leaked")))
