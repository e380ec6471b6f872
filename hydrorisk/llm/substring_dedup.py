"""Repeated passages inside documents, by compact windows of min-hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrorisk.llm.common import whole_text
from hydrorisk.session import settle, shared_path, staging

SHINGLE = 5
GRID = 64
NO_ID = -(1 << 63)
# Bytes of text, or of pieces of it, that a task works on at once.
TOGETHER = 1 << 20
# Bands of two further min-hashes each under which windows meet again, and how far from its
# centre a window is looked at for them.
BANDS = 4
AROUND = 22
# Shingles beyond a stretch in which the other document's may lie, where words were put in.
MARGIN = 16
PASSAGE = (
    "number bigint, start bigint, length bigint, first bigint, first_start bigint,"
    " similarity double, shift bigint"
)
# Rows of a batch, about, that a task hands on at once.
HANDED_ON = 100_000
TIES = np.uint64(~((1 << 20) - 1) & (1 << 64) - 1)
XXH64 = np.array(
    [
        0x9E3779B185EBCA87,
        0xC2B2AE3D27D4EB4F,
        0x165667B19E3779F9,
        0x85EBCA77C2B2AE63,
        0x27D4EB2F165667C5,
    ],
    np.uint64,
)
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _groups(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of rows that hold about ``TOGETHER`` bytes, or of one larger row."""
    marks = np.flatnonzero(np.diff((ends - ends[0]) // TOGETHER))
    edges = np.unique(np.concatenate([[0], marks, [len(ends) - 1]])).tolist()
    yield from zip(edges[:-1], edges[1:], strict=True)


def _ranges(lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places from each low up to its high, one range after the other, and where each begins."""
    starts = np.concatenate([[0], np.cumsum(np.maximum(highs - lows, 0))])
    return np.arange(starts[-1]) + np.repeat(lows - starts[:-1], np.diff(starts)), starts


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column, and where each row's begin, with the end last."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8), ends


def _rotated(values: np.ndarray, bits: int) -> np.ndarray:
    return values << np.uint64(bits) | values >> np.uint64(64 - bits)


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 of each word ``data[start:end]``, of all words in step."""
    raw = np.frombuffer(data + bytes(8), np.uint8)
    eights, fours = (
        np.ndarray(len(data) + 1, kind, raw, strides=(1,)) for kind in (np.uint64, np.uint32)
    )
    length = ends - starts
    hashes = XXH64[4] + length.astype(np.uint64)
    for at in range(0, 24, 8):
        some = np.flatnonzero(length >= at + 8)
        lane = _rotated(eights[starts[some] + at] * XXH64[1], 31) * XXH64[0]
        hashes[some] = _rotated(hashes[some] ^ lane, 27) * XXH64[0] + XXH64[3]
    at = starts + length // 8 * 8
    some = np.flatnonzero(length % 8 >= 4)
    lane = fours[at[some]].astype(np.uint64) * XXH64[0]
    hashes[some] = _rotated(hashes[some] ^ lane, 23) * XXH64[1] + XXH64[2]
    at[some] += 4
    for byte in range(3):
        some = np.flatnonzero(length % 4 > byte)
        lane = raw[at[some] + byte] * XXH64[4]
        hashes[some] = _rotated(hashes[some] ^ lane, 11) * XXH64[0]
    for shift, factor in ((33, XXH64[1]), (29, XXH64[2])):
        hashes = (hashes ^ hashes >> np.uint64(shift)) * factor
    hashes ^= hashes >> np.uint64(32)
    for i in np.flatnonzero(length >= 32).tolist():
        hashes[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
    return hashes


def shingle_hashes(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's ``SHINGLE``-word shingles, and where those of each text begin.

    Texts lie in ``data`` one after the other, from each end to the next; their shingles do
    likewise, with the end last. A shingle is rolled over the hashes of its words.
    """
    data = data.lower()
    raw = np.frombuffer(data, np.uint8)
    # One more byte on each side is no word's.
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = (raw != 32) & (raw - np.uint8(9) > 4)
    before, after = inside[:-2].copy(), inside[2:].copy()
    before[ends[:-1][ends[:-1] < len(raw)]] = False
    after[ends[1:][ends[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside[1:-1] & ~before)
    hashes = word_hashes(data, starts, np.flatnonzero(inside[1:-1] & ~after) + 1)
    words = np.searchsorted(starts, ends)
    n = max(0, len(hashes) - SHINGLE + 1)
    rolled = np.zeros(n, np.uint64)
    for at in range(SHINGLE):
        rolled = rolled * FACTORS[0] + hashes[at : at + n]
        rolled ^= rolled >> np.uint64(29)
    own, begins = _ranges(words[:-1], words[1:] - SHINGLE + 1)
    return rolled[own] * FACTORS[1], begins


def _shingled(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, shingles, where each row's begin) of rows read together."""
    data, ends = _buffers(texts)
    for first, last in _groups(ends):
        own = ends[first : last + 1]
        yield first, last, *shingle_hashes(data[own[0] : own[-1]].tobytes(), own - own[0])


def _over_stretches(function: np.ufunc, values: np.ndarray, length: int) -> np.ndarray:
    """The least or greatest of each ``length`` values in a row, by doubling."""
    reach = 1
    while 2 * reach <= length:
        values = function(values[:-reach], values[reach:])
        reach *= 2
    rest = length - reach
    return function(values[:-rest], values[rest:]) if rest else values


def compact_windows(
    values: np.ndarray, least: int, starts: np.ndarray | None = None
) -> np.ndarray:
    """Rows (left, centre, right): nodes of the Cartesian tree over at least ``least`` values.

    The centre holds the minimum of its node, so all stretches inside the node that hold
    the centre share that minimum; every stretch of ``least`` values or more belongs to
    exactly one node. Places break ties by a hash in the lowest bits, which keeps the
    tree shallow for repetitive texts. With ``starts`` (the end last) the values are those of
    several texts, each with its own tree.

    Only values that are the minimum of some stretch of ``least`` are looked at one by one: a
    node's next smaller value on either side is that of a larger node, so it is among them.
    """
    n = len(values)
    if n < least:
        return np.zeros((0, 3), np.int64)
    starts = np.array([0, n]) if starts is None else starts
    begin, end = (np.repeat(edge, np.diff(starts)) for edge in (starts[:-1], starts[1:]))
    place = (np.arange(n) - begin).astype(np.uint64) * FACTORS[2] >> np.uint64(44)
    order = (values & TIES) | place
    lowest = np.zeros(n + least - 1, np.uint64)
    inside = np.arange(n - least + 1) + least <= end[: n - least + 1]
    lowest[least - 1 : n] = np.where(inside, _over_stretches(np.minimum, order, least), 0)
    centre = np.flatnonzero(_over_stretches(np.maximum, lowest, least) == order)
    held = order[centre].tolist()
    before, after, smaller = [-1] * len(held), [len(held)] * len(held), []
    for i, value in enumerate(held):
        while smaller and held[smaller[-1]] > value:
            after[smaller.pop()] = i
        if smaller:
            before[i] = smaller[-1]
        smaller.append(i)
    edges = np.concatenate([centre, [n, -1]])
    left = np.maximum(edges[before] + 1, begin[centre])
    right = np.minimum(edges[after], end[centre]) - 1
    return np.stack([left, centre, right], 1)[right - left + 1 >= least]


def _mixed(values: np.ndarray, function: int) -> np.ndarray:
    """The function's order of shingles: a bijection of their 64-bit hashes."""
    mixed = (values ^ FACTORS[1]) * (FACTORS[0] + np.uint64(2 * function))
    mixed ^= mixed >> np.uint64(32)
    return mixed * FACTORS[2]


def window_keys(
    hashes: np.ndarray, least: int, functions: int, starts: np.ndarray | None = None
) -> np.ndarray:
    """Rows (key, centre, left, right) by which stretches sharing a min-hash meet;
    left and right tell how far the node reaches from its centre.

    A node is keyed by the shingle at its centre. Every stretch of ``least`` shingles lies in
    exactly one node of each function, with its minimum at the centre, so equal stretches
    share a key of each, wherever they stand. With ``starts`` the hashes are those of several
    texts.
    """
    rows = []
    for function in range(functions):
        nodes = compact_windows(_mixed(hashes, function), least, starts)
        if len(nodes):
            left, centre, right = nodes.T
            keys = _mixed(hashes[centre], 10 + function)
            # Even keys have the smallest document as head, odd ones the largest.
            keys = (keys & ~np.uint64(1)) | np.uint64(function % 2)
            rows.append(np.stack([keys.view(np.int64), centre, centre - left, right - centre], 1))
    return np.concatenate(rows) if rows else np.zeros((0, 4), np.int64)


def alike_stretches(
    own: np.ndarray,
    other: np.ndarray,
    least: int,
    similarity: float,
    own_starts: np.ndarray | None = None,
    other_starts: np.ndarray | None = None,
) -> list[tuple[int, int, float]]:
    """(start, end, Jaccard) of maximal stretches of ``own`` whose shingles ``other`` holds.

    Runs of shared shingles are joined over gaps while the shared part stays above
    2s / (1 + s), which for stretches of equal length is a Jaccard similarity of s. Shingles
    are hashes of 32 bits. With starts (the end last) each row of ``own`` is compared with
    its row of ``other``; what is told are places in the whole of ``own``.
    """
    share = 2 * similarity / (1 + similarity)
    own_starts = np.array([0, len(own)]) if own_starts is None else own_starts
    other_starts = np.array([0, len(other)]) if other_starts is None else other_starts
    rows = np.arange(len(own_starts) - 1)
    row = np.repeat(rows, np.diff(own_starts))
    mine = own.astype(np.uint64) | row.astype(np.uint64) << np.uint64(32)
    row = np.repeat(rows, np.diff(other_starts)).astype(np.uint64)
    theirs = np.sort(other.astype(np.uint64) | row << np.uint64(32))
    if not len(mine) or not len(theirs):
        return []
    at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
    # A place that is not shared parts the rows.
    gapped, gaps = np.arange(len(own)) + np.repeat(rows, np.diff(own_starts)), len(rows)
    shared = np.zeros(len(own) + gaps + 1, np.int8)
    shared[1 + gapped] = theirs[at] == mine
    edges = np.flatnonzero(np.diff(shared)).reshape(-1, 2)
    of = np.searchsorted(own_starts + np.arange(gaps + 1), edges[:, 0], "right") - 1
    result, found, last = [], [], -1
    for (start, end), row in zip((edges - of[:, None]).tolist(), of.tolist(), strict=True):
        if row != last:
            result += found
            found, last = [], row
        run = (start, end, end - start)
        while found:
            first, _, inside = found[-1]
            if inside + run[2] < share * (run[1] - first):
                break
            found.pop()
            run = (first, run[1], inside + run[2])
        found.append(run)
    return [
        (start, end, inside / (2 * (end - start) - inside))
        for start, end, inside in result + found
        if end - start >= least
    ]


def _number(id_col: str, kind: str) -> Column:
    """A long for each id: itself if it is a whole number, else a hash; NULL ids share one."""
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    number = F.col(id_col).cast("bigint") if whole else F.xxhash64(F.col(id_col).cast("string"))
    return F.when(F.col(id_col).isNull(), F.lit(NO_ID)).otherwise(number)


def _windows(texts: DataFrame, least: int, functions: int) -> DataFrame:
    """(number, key, centre, left, right): all windows of all texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("number").to_numpy()
            for first, _, hashes, starts in _shingled(batch.column("text")):
                key, centre, left, right = window_keys(hashes, least, functions, starts).T
                of = np.searchsorted(starts, centre, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(numbers[first + of], pa.int64()),
                        pa.array(key, pa.int64()),
                        pa.array(centre - starts[of], pa.int32()),
                        pa.array(left, pa.int32()),
                        pa.array(right, pa.int32()),
                    ],
                    ["number", "key", "centre", "left", "right"],
                )

    return texts.mapInArrow(cut, "number bigint, key bigint, centre int, left int, right int")


def _met(windows: DataFrame) -> DataFrame:
    """Windows that are not alone under their key, with the key's ``head`` and ``size``.

    The head is the window of the smallest document for even keys, of the largest for odd ones.
    """
    under = Window.partitionBy("key")
    window = F.struct("number", "centre", "left", "right")
    met = windows.withColumns(
        {
            "least": F.min(window).over(under),
            "most": F.max(window).over(under),
            "size": F.count(F.lit(1)).over(under),
        }
    )
    head = F.when(F.col("key") % 2 == 0, F.col("least")).otherwise(F.col("most"))
    return met.filter("size > 1").withColumn("head", head).drop("least", "most")


def _candidates(met: DataFrame, least: int) -> DataFrame:
    """(number, first, shift, low, high): a stretch of a document that may repeat one of ``first``.

    Each window meets its key's head. Windows that overlap in fewer than ``least`` shingles
    when laid over each other cannot hold a common passage. What is left is folded per
    pair and shift.
    """
    left, right = (F.least(side, f"head.{side}") for side in ("left", "right"))
    return (
        met.filter(F.col("number") != F.col("head.number"))
        .select(
            "number",
            F.col("head.number").alias("first"),
            (F.col("centre") - F.col("head.centre")).alias("shift"),
            (F.col("centre") - left).alias("low"),
            (F.col("centre") + right + 1).alias("high"),
        )
        .filter(F.col("high") - F.col("low") >= least)
        .groupBy("number", "first", "shift")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
    )


def _unmet(met: DataFrame, passages: DataFrame) -> DataFrame:
    """The windows, but for the heads, of keys with windows whose passage is not their head's.

    ``settled`` are those with a verified passage around their centre in common with the head.
    """
    others = met.filter(
        (F.col("size") > 2)
        & ((F.col("number") != F.col("head.number")) | (F.col("centre") != F.col("head.centre")))
    ).withColumns({"first": F.col("head.number"), "shift": F.col("centre") - F.col("head.centre")})
    found = passages.select(
        "number",
        "first",
        "shift",
        F.col("start").alias("low"),
        (F.col("start") + F.col("length") - (SHINGLE - 1)).alias("high"),
    )
    settled = (
        others.join(found, ["number", "first", "shift"])
        .filter("low <= centre AND centre < high")
        .select("key", "number", "centre", F.lit(True).alias("settled"))
        .distinct()
    )
    flagged = settle(
        others.join(settled, ["key", "number", "centre"], "left").select(
            "key",
            "number",
            "centre",
            "left",
            "right",
            F.coalesce("settled", F.lit(False)).alias("settled"),
        ),
        "flagged",
    )
    keys = flagged.groupBy("key").agg(
        F.count(F.lit(1)).alias("members"), F.bool_and("settled").alias("done")
    )
    return flagged.join(keys.filter("members > 1 AND NOT done").select("key"), "key", "left_semi")


def _sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of values, and of values times place, from which any stretch is hashed."""
    with np.errstate(over="ignore"):
        plain, placed = np.zeros((2, len(values) + 1), np.uint64)
        np.cumsum(values, out=plain[1:])
        np.cumsum(values * np.arange(len(values), dtype=np.uint64), out=placed[1:])
    return plain, placed


def stretch_hashes(hashes: np.ndarray, starts: np.ndarray, length: int) -> list[np.ndarray]:
    """Two independent 64-bit hashes of the ``length`` shingles from each start."""
    found = []
    with np.errstate(over="ignore"):
        for function in (61, 83):
            plain, placed = _sums(_mixed(hashes, function))
            total = plain[starts + length] - plain[starts]
            ordered = placed[starts + length] - placed[starts] - starts.astype(np.uint64) * total
            found.append(_mixed(total ^ (ordered * FACTORS[2]), function + 1).view(np.int64))
    return found


def _stretch_starts(
    centre: np.ndarray, left: np.ndarray, right: np.ndarray, shingles: int, least: int
) -> np.ndarray:
    """Starts of all stretches of ``least`` shingles that hold a window's centre and lie inside it."""
    first = np.maximum(centre - left, centre - least + 1)
    last = np.minimum(centre, centre + right - least + 1)
    edges = np.bincount(first, minlength=shingles + 1) - np.bincount(last + 1, minlength=shingles + 1)
    return np.flatnonzero(np.cumsum(edges))


def finer_keys(
    hashes: np.ndarray, keys: np.ndarray, centres: np.ndarray, begin: np.ndarray, end: np.ndarray
) -> np.ndarray:
    """Per band, the windows' keys joined with two further min-hashes around their centres.

    ``begin`` and ``end`` bound the text that each window is of.
    """
    around = centres[:, None] + np.arange(-AROUND, AROUND + 1)
    around = np.clip(around, begin[:, None], end[:, None] - 1)
    found = []
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            joined = keys.view(np.uint64)
            for i in (0, 1):
                mixed = _mixed(hashes, 20 + 2 * band + i)
                joined = joined ^ (mixed[around].min(axis=1) * FACTORS[i])
            found.append(_mixed(joined, 40 + band).view(np.int64))
    return np.stack(found)


AGAIN = "exact boolean, key bigint, proof bigint, number bigint, centre int, left int, right int"


def _again(texts: DataFrame, unmet: DataFrame, least: int) -> DataFrame:
    """What windows without their head's passage meet under again; texts are read once.

    ``exact`` rows are stretches of ``least`` shingles from ``centre`` on, keyed by two hashes of
    the whole stretch: all that share them hold the same passage. The others are the windows
    under their finer keys.
    """
    sides = ("key", "centre", "left", "right")
    wanted = unmet.groupBy("number").agg(F.collect_list(F.struct(*sides)).alias("windows"))
    names = [f.split()[0] for f in AGAIN.split(", ")]
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = batch.column("windows")
            ends = windows.offsets.to_numpy()
            flat = windows.values
            fields = [flat.field(side).to_numpy().astype(np.int64) for side in sides]
            numbers = batch.column("number").to_numpy()
            for low, high, hashes, begins in _shingled(batch.column("text")):
                key, centre, left, right = (f[ends[low] : ends[high]] for f in fields)
                of = np.repeat(np.arange(high - low), np.diff(ends[low : high + 1]))
                # Of rows that share an id, a text may be too short for another's windows.
                fits = begins[of] + centre + right < begins[of + 1]
                key, centre, left, right, of = (f[fits] for f in (key, centre, left, right, of))
                begin, end = begins[of], begins[of + 1]
                starts = _stretch_starts(begin + centre, left, right, len(hashes), least)
                stretches, proofs = stretch_hashes(hashes, starts, least)
                finer = finer_keys(hashes, key, begin + centre, begin, end).ravel()
                held = np.searchsorted(begins, starts, "right") - 1
                n, m = len(starts), len(finer)
                columns = [
                    np.arange(n + m) < n,
                    np.concatenate([stretches, finer]),
                    np.concatenate([proofs, np.zeros(m, np.int64)]),
                    numbers[low + np.concatenate([held, np.tile(of, BANDS)])],
                    np.concatenate([starts - begins[held], np.tile(centre, BANDS)]),
                    np.concatenate([np.zeros(n, np.int64), np.tile(left, BANDS)]),
                    np.concatenate([np.zeros(n, np.int64), np.tile(right, BANDS)]),
                ]
                arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
                yield from pa.table(arrays, names).to_batches(HANDED_ON)

    return (
        texts.join(wanted, "number")
        .select("number", "text", "windows")
        .mapInArrow(cut, AGAIN)
    )


def _exact_passages(stretches: DataFrame, least: int) -> DataFrame:
    """Passages of stretches that share both hashes; each is told from the smallest document's.

    Counts per key are combined before the shuffle, and heads are stored, so that the join
    has a shuffle of its own, in which a key that many documents share is split.
    """
    rows = stretches.select("key", "proof", "number", F.col("centre").alias("start"))
    heads = (
        rows.groupBy("key", "proof")
        .agg(F.min(F.struct("number", "start")).alias("head"), F.max("number").alias("most"))
        .filter("head.number <> most")
        .select("key", "proof", "head")
    )
    heads = settle(heads, "heads")
    met = rows.join(heads, ["key", "proof"]).filter(F.col("number") != F.col("head.number"))
    told = met.select(
        "number", "start", F.col("head.number").alias("first"), (F.col("start") - F.col("head.start")).alias("shift")
    )
    order = Window.partitionBy("number", "first", "shift").orderBy("start")
    # Rows that share an id may repeat a start.
    runs = told.withColumn("run", F.col("start") - F.dense_rank().over(order))
    return runs.groupBy("number", "first", "shift", "run").agg(
        F.min("start").cast("bigint").alias("start"), F.max("start").cast("bigint").alias("last")
    ).select(
        "number",
        "start",
        (F.col("last") - F.col("start") + least + SHINGLE - 1).alias("length"),
        "first",
        (F.col("start") - F.col("shift")).cast("bigint").alias("first_start"),
        F.lit(1.0).alias("similarity"),
        F.col("shift").cast("bigint").alias("shift"),
    )


def _pieces(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(number, low, high, hashes): shingle hashes of the asked stretches, each text read once."""
    wanted = (
        asked.distinct()
        .groupBy("number")
        .agg(F.collect_list(F.struct("low", "high")).alias("stretches"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stretches = batch.column("stretches")
            ends = stretches.offsets.to_numpy()
            fields = [stretches.values.field(side).to_numpy() for side in ("low", "high")]
            numbers = batch.column("number").to_numpy()
            for first, last, hashes, begins in _shingled(batch.column("text")):
                hashes = (hashes >> np.uint64(32)).astype(np.uint32)
                low, high = (f[ends[first] : ends[last]] for f in fields)
                of = np.repeat(np.arange(last - first), np.diff(ends[first : last + 1]))
                begin, end = begins[of], begins[of + 1]
                own = np.minimum(begin + low, end), np.minimum(begin + high, end)
                sizes = np.cumsum(np.maximum(own[1] - own[0], 0)) * hashes.itemsize
                for a, b in _groups(np.concatenate([[0], sizes])):
                    places, starts = _ranges(own[0][a:b], own[1][a:b])
                    parts = pa.Array.from_buffers(
                        pa.large_binary(),
                        b - a,
                        [
                            None,
                            pa.py_buffer(starts * hashes.itemsize),
                            pa.py_buffer(hashes[places]),
                        ],
                    )
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(numbers[first + of[a:b]], pa.int64()),
                            pa.array(low[a:b], pa.int32()),
                            pa.array(high[a:b], pa.int32()),
                            parts.cast(pa.binary()),
                        ],
                        ["number", "low", "high", "hashes"],
                    )

    return (
        texts.join(wanted, "number")
        .select("number", "text", "stretches")
        .mapInArrow(cut, "number bigint, low int, high int, hashes binary")
    )


def _verified(texts: DataFrame, met: DataFrame, least: int, similarity: float) -> DataFrame:
    """Passages that windows really have in common with their key's head, stored."""
    found = settle(_candidates(met, least), "stretches")
    # Stretches are cut on a grid, so that one of a document is asked for once by many others.
    def grid(low: Column, high: Column) -> list[Column]:
        first = F.greatest(low, F.lit(0))
        return [
            (first - first % GRID).cast("int"),
            (high - high % GRID + GRID).cast("int"),
        ]

    own = grid(F.col("low"), F.col("high"))
    other = grid(F.col("low") - F.col("shift") - MARGIN, F.col("high") - F.col("shift") + MARGIN)
    found = found.select(
        "number",
        "first",
        "shift",
        "low",
        "high",
        own[0].alias("own_low"),
        own[1].alias("own_high"),
        other[0].alias("first_low"),
        other[1].alias("first_high"),
    )
    asked = found.select("number", "own_low", "own_high").union(
        found.select("first", "first_low", "first_high")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = ("number", "first", "shift", "low", "high", "own_low")
            fields = [batch.column(c).to_numpy().astype(np.int64) for c in sides]
            # Shingles are hashes of four bytes.
            (own, own_ends), (other, other_ends) = (
                (data.view(np.uint32), ends // 4)
                for data, ends in map(_buffers, (batch.column("own"), batch.column("other")))
            )
            for a, b in _groups((own_ends + other_ends) * 4):
                number, first, shift, low, high, own_low = (f[a:b] for f in fields)
                mine, starts = _ranges(
                    own_ends[a:b] + low - own_low,
                    np.minimum(own_ends[a:b] + high - own_low, own_ends[a + 1 : b + 1]),
                )
                theirs = other_ends[a : b + 1]
                found = alike_stretches(
                    own[mine],
                    other[theirs[0] : theirs[-1]],
                    least,
                    similarity,
                    starts,
                    theirs - theirs[0],
                )
                start, end, jaccard = np.array(found, np.float64).reshape(-1, 3).T
                start, end = start.astype(np.int64), end.astype(np.int64)
                of = np.searchsorted(starts, start, "right") - 1
                at = low[of] + start - starts[of]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(number[of]),
                        pa.array(at),
                        pa.array(end - start + SHINGLE - 1),
                        pa.array(first[of]),
                        pa.array(np.maximum(at - shift[of], 0)),
                        pa.array(jaccard),
                        pa.array(shift[of]),
                    ],
                    [field.split()[0] for field in PASSAGE.split(", ")],
                )

    columns = ["number", "first", "shift", "low", "high", "own_low", "own", "other"]
    spark, path = texts.sparkSession, shared_path(texts.sparkSession, "passages")
    # The pieces go once their passages are stored.
    with staging(spark):
        pieces = settle(_pieces(texts, asked.toDF("number", "low", "high")), "pieces")
        ours = pieces.toDF("number", "own_low", "own_high", "own")
        theirs = pieces.toDF("first", "first_low", "first_high", "other")
        both = found.join(ours, ["number", "own_low", "own_high"]).join(
            theirs, ["first", "first_low", "first_high"]
        )
        both.select(*columns).mapInArrow(verify, PASSAGE).write.parquet(path)
    return spark.read.schema(PASSAGE).parquet(path)


def repeated_passages(
    docs: DataFrame,
    words: int = 50,
    similarity: float = 0.8,
    functions: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per passage found again: ``id_col``, start, length, first_id, first_start, similarity.

    A passage is a stretch of ``words`` words or more (split at white space, A-Z
    lower-cased) whose five-word shingles have a Jaccard similarity of ``similarity`` or
    more with a stretch of the document ``first_id``; starts and lengths are in words. Windows
    of documents meet under keys. The smallest or the largest id that shares a window's key
    stands for all documents whose passage around the window's centre it holds, so copies of
    a passage give a row or two each and not one per pair. Both ends of a row hold the passage.

    Windows under a key whose passage is not their head's, as under a fragment that many texts
    share, meet again. Every stretch of the least length around their centres is keyed by
    hashes of the whole stretch, under which all rows hold one passage and the smallest
    document stands for all: no exact repeat is lost, whatever the keys' sizes, and nothing
    is compared in pairs. Repeats that are only similar meet under the key joined with pairs of
    further min-hashes, whose head is verified like the first. Those at the similarity
    share a min-hash of ``functions`` with probability 1 - (1 - s)^functions; inside a key that
    unlike texts share, one of ``BANDS`` pairs with probability 1 - (1 - s^2)^BANDS.

    Rows that share an id are one document, as are those with NULL ids; repeats inside a
    document are not reported. NULL, empty and shorter texts hold no passage. An empty
    table gives no rows; other columns are not read. Starts jobs, with candidate stretches
    and their shingles stored in the shared folder; texts cross one
    shuffle, to meet what is asked of them.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    least = words - SHINGLE + 1
    texts = docs.select(_number(id_col, kind).alias("number"), whole_text(text_col).alias("text"))
    met = settle(_met(_windows(texts, least, functions)), "met")
    passages = _verified(texts, met, least, similarity)
    again = settle(_again(texts, settle(_unmet(met, passages), "unmet"), least), "again")
    exact = settle(_exact_passages(again.filter("exact"), least), "exact")
    finer = again.filter("NOT exact").select("number", "key", "centre", "left", "right")
    near = _verified(texts, settle(_met(finer), "met-again"), least, similarity)
    passages = passages.unionByName(exact).unionByName(near)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        def back(c: str) -> Column:
            return F.when(F.col(c) != NO_ID, F.col(c)).cast(kind)

        named = passages.withColumns({"id": back("number"), "first_id": back("first")})
    else:
        ids = docs.select(_number(id_col, kind).alias("n"), F.col(id_col).alias("i")).distinct()
        named = passages.join(ids.toDF("number", "id"), "number").join(
            ids.toDF("first", "first_id"), "first"
        )
    return named.select(
        F.col("id").alias(id_col), "start", "length", "first_id", "first_start", "similarity"
    ).distinct()
