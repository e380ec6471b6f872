import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from hydrorisk.llm.cuckoo import CuckooFilter
from hydrorisk.llm.line_dedup import drop_frequent_lines, empty_index, update_index

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def brute(rows, least):
    keys = [[line.strip(SPACE).translate(LOWER) for line in (t or "").split("\n")] for _, t in rows]
    counts = Counter(k for own in keys for k in set(own) if k)
    result = []
    for (i, t), own in zip(rows, keys, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, own, strict=True) if not k or counts[k] < least]
        result.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(result), counts


def line_rows():
    rows = [(i, f"\tCookie notice \nbody {i}\n\nRIGHTS reserved\r\nbody {i}") for i in range(30)]
    rows += [(100 + i, "cookie NOTICE") for i in range(3)] + [(200, "only\nunique\u00a0\nlines ")]
    return rows


def test_matches_brute_force(make_docs, odd_rows):
    rows = odd_rows + line_rows()
    docs = make_docs(rows).withColumns({"key": F.lit("x"), "doc": F.lit(1), "n_lines": F.lit(-1)})
    want, _ = brute(rows, 10)
    for filter_bytes in (64 << 20, 0):
        found = drop_frequent_lines(docs, min_docs=10, filter_bytes=filter_bytes)
        got = [(str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()]
        assert sorted(got) == want
        assert {"key", "doc", "lang"} <= set(found.columns)
    assert drop_frequent_lines(make_docs([])).count() == 0


def state(index):
    counts = {bytes(r.key): r.documents for r in index.counts.collect()}
    return counts, {r.shard: CuckooFilter.from_bytes(bytes(r.cells)) for r in index.filters.collect()}


def test_insertions_are_reversible(spark, make_docs):
    rows = line_rows()
    first, second = rows[:20], rows[20:]
    start = empty_index(spark, min_docs=10, shards=4)
    one = update_index(start, make_docs(first))
    both = update_index(one, make_docs(second))
    back = update_index(both, removed=make_docs(second))
    gone = update_index(back, removed=make_docs(first))
    assert state(back)[0] == state(one)[0] and state(gone)[0] == {}
    for index, held in ((one, first), (both, rows), (back, first)):
        _, counts = brute(held, 10)
        exact, filters = state(index)
        digest = {hashlib.sha256(k.encode()).digest(): n for k, n in counts.items()}
        assert exact == digest
        for key, n in digest.items():
            own = filters.get(int.from_bytes(key[8:12], "big") % 4)
            if n >= 10:
                assert own.contains(np.frombuffer(key, np.uint8).reshape(1, 32))[0]
    assert not any(f.table.any() for f in state(gone)[1].values())


def test_incremental_equals_whole(spark, make_docs):
    rows = line_rows()
    index = update_index(empty_index(spark, 10), make_docs(rows[:17]))
    index = update_index(index, make_docs(rows[17:]))
    found = drop_frequent_lines(make_docs(rows), index=index)
    got = [(str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()]
    assert sorted(got) == brute(rows, 10)[0]


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    digests = rng.integers(0, 256, (3000, 32), dtype=np.uint8)
    others = rng.integers(0, 256, (20000, 32), dtype=np.uint8)
    cells = CuckooFilter.build(digests)
    assert cells.contains(digests).all() and cells.contains(others).mean() < 0.002
    again = CuckooFilter.from_bytes(cells.to_bytes())
    again.delete(digests[:1000])
    assert again.contains(digests[1000:]).all() and again.contains(digests[:1000]).mean() < 0.05
    assert len(again.contains(np.zeros((0, 32), np.uint8))) == 0
