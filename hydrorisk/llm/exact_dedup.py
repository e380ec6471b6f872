"""Exact deduplication by a 128-bit content hash, with bytes compared inside a hash group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrorisk.llm.common import as_rows, ascii_lower, id_key, original, whole_text
from hydrorisk.session import settle


def _hashed(rows: DataFrame, bits: int) -> DataFrame:
    digest = F.unhex(F.md5("text"))
    return rows.withColumn("hash", digest if bits == 128 else F.substring(digest, 1, bits // 8))


def _groups(rows: DataFrame, keep: str) -> DataFrame:
    """One row per distinct content: the id that stays and the number of rows.

    Grouping by the hash and the bytes compares the bytes of equal hashes. Counts and
    ids are combined before the shuffle, so a content that a third of all rows hold
    crosses it once per task.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    return rows.groupBy("hash", "text").agg(
        best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )


def _matched(rows: DataFrame, keep: str, *, keepers_only: bool) -> DataFrame:
    """Rows with ``keep_id`` and ``group_size`` of their content, or only each content's keeper.

    The table of groups is stored without texts, so no text crosses a shuffle for the
    join unless its hash stands for two contents. Such hashes are joined by bytes too.
    """
    groups = _groups(rows.select("id", "text", "hash"), keep)
    stored = settle(
        groups.groupBy("hash").agg(
            F.count(F.lit(1)).alias("contents"),
            F.first("keep_id").alias("keep_id"),
            F.first("group_size").alias("group_size"),
        ),
        "contents",
    )

    def joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        if keepers_only:  # spread by id, so a large group of copies is no hot key
            left = left.withColumn("id_key", id_key("id"))
            right = right.withColumn("id_key", id_key("keep_id"))
            on = [*on, "id_key"]
        return left.join(right, on)

    single = stored.filter("contents = 1").drop("contents")
    result = joined(rows, single, ["hash"])
    shared = stored.filter("contents > 1").select("hash")
    if not shared.isEmpty():
        by_bytes = joined(
            rows.join(shared, "hash", "left_semi"),
            groups.join(shared, "hash", "left_semi"),
            ["hash", "text"],
        )
        result = result.unionByName(by_bytes)
    return result


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    hash_bits: int = 128,
) -> DataFrame:
    """Per row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after lower-casing A-Z; of equal texts the row
    with the smallest (or ``keep="largest"``) id stays. NULL texts count as empty, and the
    empty texts form a group like any other. A NULL id stays only where a group has no
    other. Rows that repeat both id and text are one document: they count in group_size
    and share its decision; ``drop_exact_copies`` keeps one of them. An empty table gives
    an empty result; columns besides id and text are not read. A narrower ``hash_bits``
    (a multiple of 8) changes no result.

    Starts a job: the groups are stored in the shared folder.
    """
    rows = _hashed(
        docs.select(F.col(id_col).alias("id"), ascii_lower(whole_text(text_col)).alias("text")),
        hash_bits,
    )
    rows = rows.withColumn("text_sha256", F.sha2("text", 256))
    return _matched(rows, keep, keepers_only=False).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest"
) -> DataFrame:
    """The rows of ``docs``, all columns, that ``exact_dedup`` keeps; one of repeated rows."""
    rows = _hashed(
        as_rows(docs, id=F.col(id_col), text=ascii_lower(whole_text(text_col))), 128
    )
    kept = _matched(rows, keep, keepers_only=True)
    # Only repeats of a keeper's own id are left to fold.
    return original(kept.dropDuplicates(["hash", "text", "id_key"]))
