import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrorisk.llm.substring_dedup import (
    alike_stretches,
    compact_windows,
    repeated_passages,
    window_keys,
)


@pytest.mark.parametrize("kinds", [3, 50, 10**6])
def test_each_stretch_lies_in_one_window_with_its_minimum(kinds):
    rng = np.random.default_rng(kinds)
    values = rng.integers(0, kinds, 60).astype(np.uint64) << np.uint64(20)
    least = 7
    nodes = compact_windows(values, least)
    for i in range(60):
        for j in range(i + least - 1, 60):
            own = [(a, c, b) for a, c, b in nodes if a <= i <= c <= j <= b]
            assert len(own) == 1 and values[own[0][1]] == values[i : j + 1].min()
    assert len(compact_windows(values[: least - 1], least)) == 0


@pytest.mark.parametrize("length", [46, 60, 200])
def test_equal_stretches_share_a_key_of_every_function(length):
    """Wherever they stand, and be they of the least length only."""
    rng = np.random.default_rng(length)
    draw = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    for _ in range(30):
        passage = draw(length)
        before = [int(n) for n in rng.integers(0, 300, 2)]
        one, two = (np.concatenate([draw(n), passage, draw(50)]) for n in before)
        for function in range(2):
            keys = []
            for text, start in ((one, before[0]), (two, before[1])):
                rows = window_keys(text, 46, 2)
                rows = rows[rows[:, 0] % 2 == function]
                inside = (rows[:, 1] >= start) & (rows[:, 1] < start + length)
                keys.append(set(rows[inside, 0].tolist()))
            assert keys[0] & keys[1]


def test_alike_stretches():
    other = np.arange(1000)
    own = np.concatenate([np.arange(5000, 5030), np.arange(200, 300), np.arange(6000, 6040)])
    assert alike_stretches(own, other, 46, 0.8) == [(30, 130, 1.0)]
    own[80:84] = 9999
    [(start, end, jaccard)] = alike_stretches(own, other, 46, 0.8)
    assert (start, end) == (30, 130) and abs(jaccard - 96 / 104) < 1e-9
    own[60:100] = 9999
    assert alike_stretches(own, other, 46, 0.8) == []


def test_planted_passages(make_docs, odd_rows):
    rnd = random.Random(6)
    noise = lambda k: [f"n{rnd.randrange(10**7)}" for _ in range(k)]
    rows, want = list(odd_rows), set()
    for p in range(15):
        passage = noise(rnd.randrange(51, 140))
        for copy in range(3):
            own = list(passage)
            if copy == 2 and len(own) > 90:
                own[len(own) // 2] = "changed"
            rows.append((100 + 10 * p + copy, " ".join(noise(rnd.randrange(300)) + own + noise(200))))
            want.add(100 + 10 * p + copy)
        rows.append((100 + 10 * p + 5, " ".join(noise(100) + passage[:40] + noise(100))))
    docs = make_docs(rows).withColumns({"number": F.lit("x"), "key": F.lit(1), "first": F.lit(2)})
    found = repeated_passages(docs, words=50).collect()
    planted = [r for r in found if r.doc_id and r.doc_id >= 100]
    assert {r.doc_id for r in planted} | {r.first_id for r in planted} == want
    texts = {i: (t or "").lower().split() for i, t in rows}
    for r in planted:
        assert r.first_id != r.doc_id and r.length >= 50 and r.similarity >= 0.8
        if r.similarity == 1:
            a = texts[r.doc_id][r.start : r.start + r.length]
            assert a == texts[r.first_id][r.first_start : r.first_start + r.length]
    # The long text and its upper-case copy are one passage; nothing else repeats.
    assert {frozenset((r.doc_id, r.first_id)) for r in found if not r.doc_id or r.doc_id < 100} == {frozenset((6, 7))}
    assert repeated_passages(make_docs([])).count() == 0


def test_other_ids(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [("b", passage + " x"), ("a", "y " + passage), (None, passage), (None, passage)]
    found = repeated_passages(spark.createDataFrame(rows, "name string, body string"), id_col="name", text_col="body")
    ids = {frozenset((r.name, r.first_id)) for r in found.collect()}
    assert set().union(*ids) == {"a", "b", None}


def brute_pairs(texts, words):
    """Pairs of documents with an equal stretch of ``words`` words."""
    holders = {}
    for i, text in texts.items():
        for at in range(len(text) - words + 1):
            holders.setdefault(tuple(text[at : at + words]), set()).add(i)
    return [group for group in holders.values() if len(group) > 1]


def test_repeats_around_a_fragment_that_all_documents_share(make_docs):
    """A key of 700 windows that share 45 words: every exact repeat is told, similar ones for the most part."""
    rnd = random.Random(12)
    noise = lambda k: [f"n{rnd.randrange(10**7)}" for _ in range(k)]
    fragment = noise(45)
    rows, similar = [], []
    for i in range(700):
        rows.append([i, noise(rnd.randrange(20, 80)) + fragment + noise(rnd.randrange(20, 80))])
    for p in range(60):
        # Exactly fifty words, or some more, around the fragment.
        before = noise(rnd.randrange(0, 6))
        passage = before + fragment + noise(5 - len(before) + rnd.randrange(0, 10))
        for copy in range(2):
            rows.append([1000 + 2 * p + copy, noise(30) + passage + noise(30)])
    for p in range(40):
        passage = noise(20) + fragment + noise(25)
        for copy in range(2):
            own = list(passage)
            if copy:
                own[rnd.choice([5, 85])] = "changed"
            rows.append([2000 + 2 * p + copy, noise(30) + own + noise(30)])
        similar.append({2000 + 2 * p, 2000 + 2 * p + 1})
    found = repeated_passages(make_docs([(i, " ".join(t)) for i, t in rows])).collect()
    texts = dict(map(tuple, rows))
    told = [{r.doc_id, r.first_id} for r in found]
    for r in found:
        assert r.length >= 50 and r.similarity >= 0.8 and r.doc_id != r.first_id
    groups = brute_pairs(texts, 50)
    assert len(groups) >= 60
    # Each holder of an equal passage is tied to another holder of it.
    for group in groups:
        tied = set().union(*[pair for pair in told if pair <= group])
        assert tied == group
    caught = sum(pair in told for pair in similar)
    assert caught >= 0.9 * len(similar)
    # Documents that share the fragment only are left alone.
    assert not {i for pair in told for i in pair if i < 1000}
