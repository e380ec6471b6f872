"""Shards of near-equal bytes: sampled splitters, range partition, overfull ranges subdivided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrorisk.llm.common import whole_text
from hydrorisk.session import settle

SPREAD = 1 << 53
# Bounds the boundaries, and the one row per range that is broadcast.
MOST_RANGES = 65_536


def _drawn(rows: DataFrame, per_byte: float) -> DataFrame:
    """A size-weighted sample: each byte of a row is one chance, the draw fixed by content."""
    uniform = F.pmod(F.xxhash64("id", "key", F.lit("draw")), F.lit(SPREAD)) / F.lit(float(SPREAD))
    return rows.filter(uniform < F.col("size") * F.lit(per_byte))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many boundaries lie at or below ``key``: a binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    # Text that the planner folds to one constant array.
    array = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = [1 << p for p in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda low, step: F.when(
            (low + step <= len(bounds)) & (F.get(array, low + step - 1) <= key), low + step
        ).otherwise(low),
    )


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranges: int = 512,
    rows_per_range: int = 1_000_000,
    draws_per_range: int = 64,
    hot_share: float = 0.01,
) -> DataFrame:
    """Per row: ``id_col``, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus one (NULL: none, so 1). Shards follow the law
    ``bytes``: each holds the same bytes, up to about ``hot_share`` of a shard or one row.
    Rows are ordered by a hash of their text, so equal texts (a group) share a shard
    unless the group alone holds more than ``hot_share`` of a shard.

    Ranges are ``ranges``, or more so that one has about ``rows_per_range`` rows, which a
    task ranks, but ``MOST_RANGES`` at most. Their boundaries are quantiles of a
    size-weighted sample of keys, of ``draws_per_range`` expected draws a range. A group above ``hot_share`` would overfill
    its range: it is subdivided by id. No more than ``shards / hot_share`` groups can be
    that large, so their list is small at any input size. Exact bytes of every range then
    give each range, and each group in it, its place; the shard is the place of its middle.

    Slots are gapless from 0 in each shard. Repeated rows, NULL ids and ties take
    neighbouring slots in no particular order; an empty table gives no rows; other
    columns are not read. Starts jobs: keys without texts are stored in the shared folder.
    """
    text = whole_text(text_col)
    rows = settle(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.xxhash64(text).alias("key"),
        ),
        "keys",
    )
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = min(MOST_RANGES, max(ranges, count // rows_per_range))
    target = max(1.0, total / shards)
    # At most shards / hot_share rows: the bound holds for any input.
    hot = (
        rows.groupBy("key")
        .agg(F.sum("size").alias("group_bytes"))
        .filter(F.col("group_bytes") > hot_share * target)
        .select(
            F.col("key").alias("hot_key"),
            F.ceil(F.col("group_bytes") / F.lit(hot_share * target)).alias("parts"),
        )
    )
    hot = settle(hot, "hot-keys")
    sample = _drawn(rows, ranges * draws_per_range / max(1, total))
    quantiles = [i / ranges for i in range(1, ranges)]
    found = sample.agg(F.percentile_approx("key", quantiles, 100 * ranges)).first()[0]
    bounds = sorted(set(found or []))

    placed = rows.join(F.broadcast(hot), F.col("key") == F.col("hot_key"), "left").select(
        "id",
        "size",
        "crc",
        "key",
        _range_of(F.col("key"), bounds).alias("range"),
        "hot_key",
        F.when(
            F.col("hot_key").isNotNull(),
            F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")),
        ).alias("part"),
    )
    block = ["range", "hot_key", "part"]
    blocks = placed.groupBy(*block).agg(F.sum("size").alias("block_bytes"))
    # One row per range and per part of a hot group: bounded by the two parameters.
    before = Window.orderBy(*[F.col(c).asc_nulls_first() for c in block]).rowsBetween(
        Window.unboundedPreceding, -1
    )
    blocks = blocks.withColumn(
        "block_start", F.coalesce(F.sum("block_bytes").over(before), F.lit(0))
    )
    keys = [c.eqNullSafe(d) for c, d in ((F.col(f"p.{k}"), F.col(f"b.{k}")) for k in block)]
    placed = placed.alias("p").join(
        F.broadcast(blocks.alias("b")), keys[0] & keys[1] & keys[2]
    ).select("p.*", "block_start", "block_bytes")

    inside = Window.partitionBy(*block).orderBy("key")
    through = F.sum("size").over(inside.rangeBetween(Window.unboundedPreceding, 0))
    group = F.sum("size").over(inside.rangeBetween(0, 0))
    middle = F.col("block_start") + F.when(
        F.col("hot_key").isNull(), through - group / 2
    ).otherwise(F.col("block_bytes") / 2)
    shard = F.least(F.floor(middle / F.lit(target)).cast("int"), F.lit(shards - 1))
    ranked = placed.select(
        "id", "size", "crc", "key", *block, "block_start", shard.alias("shard")
    ).withColumn(
        "rank", F.row_number().over(Window.partitionBy(*block, "shard").orderBy("key", "id", "crc"))
    )
    ranked = settle(ranked.drop("key"), "ranks")
    order = Window.partitionBy("shard").orderBy("block_start", *block)
    starts = (
        ranked.groupBy("shard", "block_start", *block)
        .agg(F.count(F.lit(1)).alias("block_rows"))
        .select(
            "shard",
            *block,
            F.coalesce(
                F.sum("block_rows").over(order.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ).alias("start"),
        )
    )
    keys = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in ["shard", *block]]
    return (
        ranked.alias("r")
        .join(F.broadcast(starts.alias("s")), keys[0] & keys[1] & keys[2] & keys[3])
        .select(
            F.col("r.id").alias(id_col),
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            F.col("r.shard").alias("shard"),
            (F.col("start") + F.col("rank") - 1).cast("bigint").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
