import zlib

import pytest
from pyspark.sql import functions as F

from hydrorisk.llm.sharding import shard_by_bytes


def check(frame, rows, shards, slack):
    assert len(frame) == len(rows)
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    ids = ["None" if x != x else str(int(x)) for x in frame["doc_id"]]
    have = sorted(zip(ids, frame["size"], frame["text_crc32"], strict=True))
    assert have == want
    total = frame["size"].sum()
    for shard, part in frame.groupby("shard"):
        assert 0 <= shard < shards
        assert sorted(part["slot"]) == list(range(len(part)))
        assert abs(part["size"].sum() - total / shards) <= slack
    assert set(frame["law"]) <= {"bytes"} and frame["grown_shard"].isna().all()


def test_equal_bytes_and_groups(make_docs):
    rows = [(i, f"document {i % 700} " * (i % 13 + 1)) for i in range(2000)]
    frame = shard_by_bytes(make_docs(rows), shards=8).toPandas()
    check(frame, rows, 8, slack=600)
    assert (frame.groupby(["text_crc32", "size"])["shard"].nunique() == 1).all()


def test_hot_group_is_subdivided(make_docs):
    rows = [(i, "the same copy") for i in range(3000)] + [(5000 + i, f"own text {i}") for i in range(1500)]
    frame = shard_by_bytes(make_docs(rows), shards=4, ranges=64).toPandas()
    check(frame, rows, 4, slack=600)
    assert frame[frame["size"] == 14]["shard"].nunique() > 1


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows).withColumns({"shard": F.lit("x"), "key": F.lit("y"), "size": F.lit(0)})
    frame = shard_by_bytes(docs, shards=3).toPandas()
    check(frame, odd_rows, 3, slack=10**7)


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_small(make_docs, rows):
    check(shard_by_bytes(make_docs(rows)).toPandas(), rows, 8, slack=10)
