"""Spark ML's forests asked for many rows at once, in an Arrow UDF.

A forest's own ``transform`` walks every tree for every row. Here each input of a batch is placed
among the forest's thresholds once; the place tells, for all trees together, which leaves its
comparisons rule out, and the first leaf left is the one the walk would end in. The leaves'
shares are added in the order of the trees, so the votes are those of ``transform``, bit by bit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from hydrorisk.session import shared_path

# Leaves of a tree that fit one word, and rows asked for at a time, so that the words stay in cache.
MOST_LEAVES = 64
ROWS = 2048
# Rows whose words are compared at a time: two words for each of their trees.
WORD_ROWS = 256


@dataclass(frozen=True)
class Tables:
    """Thresholds per input; per forest the leaves kept by place (input x place x tree) and their shares."""

    edges: list[np.ndarray]
    kept: list[dict[int, np.ndarray]]
    shares: list[np.ndarray]


def read_trees(spark: SparkSession, forest: RandomForestClassificationModel) -> list[dict]:
    """Nodes by id of each tree, as the forest is stored; starts jobs."""
    path = shared_path(spark, "forest")
    forest.write().save(path)
    node = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("id"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("input"),
        node["split"]["leftCategoriesOrThreshold"].alias("at_most"),
        node["impurityStats"].alias("stats"),
    )
    trees: dict[int, dict] = {}
    for row in rows.collect():
        trees.setdefault(row["tree"], {})[row["id"]] = row
    return [trees[t] for t in sorted(trees)]


def _walk(nodes: dict, at: int, cuts: list, shares: list) -> None:
    """Leaves from left to right, and what each comparison rules out when it fails: its left leaves."""
    node = nodes[at]
    if node["left"] < 0:
        total = sum(node["stats"], 0.0)
        shares.append([s / total if total else 0.0 for s in node["stats"]])
        return
    first = len(shares)
    _walk(nodes, node["left"], cuts, shares)
    cuts.append((node["input"], node["at_most"][0], first, len(shares)))
    _walk(nodes, node["right"], cuts, shares)


def tables(forests: list[list[dict]], inputs: int) -> Tables | None:
    """Tables of forests over the same inputs; None if a tree has more than ``MOST_LEAVES`` leaves."""
    walked = []
    for trees in forests:
        found = []
        for nodes in trees:
            cuts, shares = [], []
            _walk(nodes, 0, cuts, shares)
            found.append((cuts, shares))
        walked.append(found)
    if max(len(shares) for found in walked for _, shares in found) > MOST_LEAVES:
        return None
    all_cuts = [cut for found in walked for cuts, _ in found for cut in cuts]
    edges = [np.unique([at for i, at, *_ in all_cuts if i == n]) for n in range(inputs)]
    kept, votes = [], []
    for found in walked:
        most = max(len(shares) for _, shares in found)
        word = next(w for w in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(w).bits)
        used = sorted({i for cuts, _ in found for i, *_ in cuts})
        left = {i: np.full((len(edges[i]) + 1, len(found)), np.iinfo(word).max, word) for i in used}
        share = np.zeros((len(found), most, len(found[0][1][0])))
        for tree, (cuts, shares) in enumerate(found):
            share[tree, : len(shares)] = shares
            for i, at, first, end in cuts:
                ruled_out = (1 << end) - (1 << first)
                place = np.searchsorted(edges[i], at) + 1
                left[i][place:, tree] &= word(np.iinfo(word).max ^ ruled_out)
        kept.append(left)
        votes.append(share)
    return Tables(edges, kept, votes)


def classes(known: Tables, values: np.ndarray) -> np.ndarray:
    """The class of most votes, the first of equals, per row and forest."""
    places = [np.searchsorted(edges, values[:, i]) for i, edges in enumerate(known.edges)]
    found = np.empty((len(values), len(known.kept)), np.int32)
    for n, (left, shares) in enumerate(zip(known.kept, known.shares, strict=True)):
        votes = np.zeros((len(values), shares.shape[2]))
        leaves = np.zeros((len(values), len(shares)), np.uint8)
        for at in range(0, len(values) if left else 0, WORD_ROWS):
            part = slice(at, at + WORD_ROWS)
            (first, table), *rest = left.items()
            word = table.take(places[first][part], 0)
            other = np.empty_like(word)
            for i, table in rest:
                word &= table.take(places[i][part], 0, out=other, mode="clip")
            np.subtract(word, 1, out=other)
            leaves[part] = np.bitwise_count(np.bitwise_xor(word, other, out=other)) - 1
        share_of = np.empty_like(votes)
        for share, leaf in zip(shares, np.ascontiguousarray(leaves.T), strict=True):
            votes += share.take(leaf, 0, out=share_of, mode="clip")
        found[:, n] = votes.argmax(1)
    return found


def forest_classes(known: Tables, inputs: list[str], outputs: list[str]) -> Column:
    """The forests' classes, one field per output; an input that is NaN is an error, as in ``VectorAssembler``."""

    @F.pandas_udf(", ".join(f"{name} int" for name in outputs))
    def answer(columns: pd.DataFrame) -> pd.DataFrame:
        values = columns.to_numpy(float)
        if np.isnan(values).any():
            raise ValueError("an input of the forest is NaN")
        parts = [classes(known, values[n : n + ROWS]) for n in range(0, len(values), ROWS)]
        found = np.concatenate(parts) if parts else np.empty((0, len(outputs)), np.int32)
        return pd.DataFrame(found, columns=outputs)

    return answer(F.struct(*inputs))
