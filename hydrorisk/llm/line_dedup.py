"""Lines found in many documents: exact reference counts, with sharded cuckoo filters before them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrorisk.llm.common import as_rows, ascii_lower, id_key, whole_text
from hydrorisk.llm.cuckoo import CuckooFilter, digest_matrix
from hydrorisk.session import settle

SPACE = " \t\n\x0b\x0c\r"
COUNTS = "shard int, key binary, documents bigint"
FILTERS = "shard int, cells binary"


@dataclass
class LineIndex:
    """State of incremental line dedup, kept as two tables.

    counts: shard, key (SHA-256 of the line's key), documents that hold it - exact.
    filters: shard, cells - a cuckoo filter of the shard's keys in ``min_docs`` or more.
    """

    counts: DataFrame
    filters: DataFrame
    min_docs: int
    min_chars: int
    shards: int

    def write(self, path: str) -> None:
        self.counts.write.parquet(f"{path}/counts")
        self.filters.write.parquet(f"{path}/filters")

    @classmethod
    def read(
        cls, spark: SparkSession, path: str, min_docs: int, min_chars: int, shards: int
    ) -> LineIndex:
        counts = spark.read.schema(COUNTS).parquet(f"{path}/counts")
        filters = spark.read.schema(FILTERS).parquet(f"{path}/filters")
        return cls(counts, filters, min_docs, min_chars, shards)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _lines(text_col: str) -> Column:
    return F.split(whole_text(text_col), "\n", -1)


def _digest(key: Column) -> Column:
    return F.unhex(F.sha2(key, 256))


def _document_keys(docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """One row per document and distinct key in it: distinct inside the row, no shuffle."""
    keys = F.array_distinct(F.transform(_lines(text_col), line_key))
    return (
        docs.select(F.explode(keys).alias("line"))
        .filter(F.char_length("line") >= min_chars)
        .select(_digest(F.col("line")).alias("key"))
    )


def empty_index(
    spark: SparkSession, min_docs: int = 10, min_chars: int = 1, shards: int = 256
) -> LineIndex:
    """An index of no documents. Take so many ``shards`` that one shard's keys fit a task."""
    return LineIndex(
        spark.createDataFrame([], COUNTS),
        spark.createDataFrame([], FILTERS),
        min_docs,
        min_chars,
        shards,
    )


def _new_cells(old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after its changes; built anew where an insertion finds no room."""
    shard = int((keys if len(keys) else old)["shard"].iloc[0])
    change = keys["change"].to_numpy() if len(keys) else np.zeros(0, int)
    digests = digest_matrix(keys["key"]) if len(keys) else np.zeros((0, 32), np.uint8)
    if len(old):
        cells = CuckooFilter.from_bytes(old["cells"].iloc[0])
        cells.delete(digests[change < 0])
        room = cells.table.size * 0.9 >= (change >= 0).sum()
        if not (room and cells.insert(digests[change > 0])):
            cells = CuckooFilter.build(digests[change >= 0])
    else:
        cells = CuckooFilter.build(digests[change >= 0])
    return pd.DataFrame({"shard": [shard], "cells": [cells.to_bytes()]})


def update_index(
    index: LineIndex,
    added: DataFrame | None = None,
    removed: DataFrame | None = None,
    text_col: str = "text",
) -> LineIndex:
    """The index after inserting and deleting whole documents; deletions undo insertions.

    Counts are summed with the change, combined before the shuffle. Only keys in
    ``min_docs`` or more documents before or after the change reach the filters.
    Removing a document that was never added makes a count negative and raises an error.
    The old index stays valid. Starts jobs: both tables are stored in the shared folder.
    """
    parts = [index.counts.select("key", F.col("documents").alias("old"), F.lit(0).alias("new"))]
    for docs, sign in ((added, 1), (removed, -1)):
        if docs is not None:
            keys = _document_keys(docs, text_col, index.min_chars)
            parts.append(keys.select("key", F.lit(0).alias("old"), F.lit(sign).alias("new")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    shard = F.conv(F.hex(F.substring("key", 9, 4)), 16, 10).cast("bigint") % index.shards
    merged = settle(
        union.groupBy("key")
        .agg(F.sum("old").alias("old"), F.sum("new").alias("change"))
        .select(
            shard.cast("int").alias("shard"),
            "key",
            "old",
            (F.col("old") + F.col("change")).alias("documents"),
        ),
        "line-counts",
    )
    checked = F.when(
        F.col("documents") < 0, F.raise_error(F.lit("a removed document was never added"))
    ).otherwise(F.col("documents"))
    counts = merged.select("shard", "key", checked.cast("bigint").alias("documents"))
    was, now = F.col("old") >= index.min_docs, F.col("documents") >= index.min_docs
    changes = merged.filter(was | now).select(
        "shard",
        "key",
        F.when(was & now, 0).when(now, 1).otherwise(-1).alias("change"),
    )
    filters = (
        index.filters.groupBy("shard")
        .cogroup(changes.groupBy("shard"))
        .applyInPandas(_new_cells, FILTERS)
    )
    return LineIndex(
        counts.filter("documents > 0"),
        settle(filters, "line-filters"),
        index.min_docs,
        index.min_chars,
        index.shards,
    )


def _passing(lines: DataFrame, index: LineIndex, most_bytes: int) -> DataFrame:
    """Lines whose key a filter may hold; all of them if the filters are too large to send."""
    size = index.filters.agg(F.sum(F.length("cells"))).first()[0] or 0
    if size > most_bytes:
        return lines
    cells = {row.shard: bytes(row.cells) for row in index.filters.collect()}
    sent = lines.sparkSession.sparkContext.broadcast(cells)
    shards = index.shards

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {shard: CuckooFilter.from_bytes(data) for shard, data in sent.value.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            digests = digest_matrix(batch.column("key").to_pylist())
            at = np.ascontiguousarray(digests[:, 8:12]).view(">u4")[:, 0] % shards
            found = np.zeros(len(digests), bool)
            order = np.argsort(at, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                held = filters.get(int(at[rows[0]]))
                if held is not None:
                    found[rows] = held.contains(digests[rows])
            yield batch.filter(pa.array(found))

    return lines.mapInArrow(probe, lines.schema)


def drop_frequent_lines(
    docs: DataFrame,
    index: LineIndex | None = None,
    min_docs: int = 10,
    min_chars: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    filter_bytes: int = 64 << 20,
) -> DataFrame:
    """All columns of ``docs`` plus n_lines, n_dropped and kept_text.

    Lines end at a line feed only. A line's key is the line without spaces and tabs,
    line, form and page feeds and carriage returns at its ends, A-Z lower-cased. Keys of at least
    ``min_chars`` code points found in ``min_docs`` or more documents lose all their lines
    in every document; the others stay, joined by line feeds. Every row is a document:
    repeated rows and NULL ids count like any other. NULL and empty texts have one empty
    line, whose key is too short to be dropped. An empty table gives no rows; columns
    of ``docs`` named like the new ones are replaced.

    ``index`` counts ``docs`` themselves by default; one kept by ``update_index`` may be
    given. Its filters, sent to the tasks while they take up to ``filter_bytes``, leave
    few lines besides the dropped ones; the exact counts decide. Above that size all
    lines meet the exact counts, with the same result. Line positions and digests
    cross shuffles; texts cross one, to meet their dropped positions. Starts jobs.
    """
    spark = docs.sparkSession
    if index is None:
        index = update_index(empty_index(spark, min_docs, min_chars), docs, text_col=text_col)
    identity = F.unhex(F.md5(F.concat_ws("\n", id_key(id_col), whole_text(text_col))))
    lines = (
        docs.select(identity.alias("doc"), F.posexplode(_lines(text_col)).alias("at", "line"))
        .select("doc", "at", line_key(F.col("line")).alias("line"))
        .filter(F.char_length("line") >= index.min_chars)
        .select("doc", "at", _digest(F.col("line")).alias("key"))
    )
    frequent = index.counts.filter(F.col("documents") >= index.min_docs).select("key")
    dropped = (
        _passing(lines, index, filter_bytes)
        .join(frequent, "key")
        .groupBy("doc")
        .agg(F.collect_set("at").alias("dropped"))
    )
    rows = as_rows(docs, doc=identity, text=whole_text(text_col))
    joined = rows.join(dropped, "doc", "left").select(
        "row",
        F.split("text", "\n", -1).alias("lines"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
    )
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    new = {
        "n_lines": F.size("lines").cast("bigint"),
        "n_dropped": F.size("dropped").cast("bigint"),
        "kept_text": F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"),
    }
    packed = joined.select(
        "row", *[column.alias(f"_{name}") for name, column in new.items()]
    )
    plain = [c for c in docs.columns if c not in new]
    return packed.select(
        *[F.col("row").getField(c).alias(c) for c in plain],
        *[F.col(f"_{name}").alias(name) for name in new],
    )


