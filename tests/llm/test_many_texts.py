"""Passes over many texts at once give what each text gives alone."""

import random

import numpy as np
import pyarrow as pa
import xxhash

from hydrorisk.llm import substring_dedup as dedup
from tests.llm.test_common_fragments import fragment_rows


def odd_texts():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("aB€\U0001f600") for _ in range(rnd.randrange(1, 45)))
    texts = ["", " ", "a", "A b\x0bc\x0cd\r\ne\tf\x1cg  ", "x " * 900, "one two three four"]
    texts += [" ".join(word() for _ in range(rnd.randrange(200))) for _ in range(40)]
    texts += [" ".join(rnd.choice("ab") for _ in range(rnd.randrange(400))) for _ in range(20)]
    return texts + [""]


def plain_shingles(text):
    mask = (1 << 64) - 1
    words = [xxhash.xxh64_intdigest(w) for w in text.encode().lower().split()]
    found = []
    for at in range(len(words) - 4):
        rolled = 0
        for word in words[at : at + 5]:
            rolled = (rolled * 0x9E3779B97F4A7C15 + word) & mask
            rolled ^= rolled >> 29
        found.append(rolled * 0xC2B2AE3D27D4EB4F & mask)
    return found


def test_shingles_and_windows_of_many_texts(monkeypatch):
    texts = odd_texts()
    column = pa.array(["left out", *texts]).slice(1)
    want = [plain_shingles(text) for text in texts]
    for together in (1, 700, 1 << 20):
        monkeypatch.setattr(dedup, "TOGETHER", together)
        rows = []
        for first, last, hashes, starts in dedup._shingled(column):
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                assert hashes[a:b].tolist() == want[len(rows)]
                rows.append(dedup.window_keys(hashes[a:b], 9, 2) + [0, a, 0, 0])
            assert len(rows) == last
            alone = np.concatenate(rows[first:last])
            joint = dedup.window_keys(hashes, 9, 2, starts)
            assert sorted(alone.tolist()) == sorted(joint.tolist())
        assert len(rows) == len(texts)


def test_windows_are_those_of_a_tree_cut_node_by_node():
    rng = np.random.default_rng(5)
    for kinds in (1, 4, 1 << 40):
        values = rng.integers(0, kinds, 500).astype(np.uint64) << np.uint64(20)
        starts = np.array([0, 0, 100, 105, 430, 500, 500])
        want = []
        for start, end in zip(starts[:-1], starts[1:], strict=True):
            own = values[start:end]
            place = np.arange(len(own), dtype=np.uint64) * dedup.FACTORS[2] >> np.uint64(44)
            order, todo = (own & dedup.TIES) | place, [(0, len(own) - 1)]
            while todo:
                left, right = todo.pop()
                if right - left + 1 >= 7:
                    centre = left + int(order[left : right + 1].argmin())
                    want.append([start + left, start + centre, start + right])
                    todo += [(left, centre - 1), (centre + 1, right)]
        assert sorted(want) == sorted(dedup.compact_windows(values, 7, starts).tolist())


def test_rows_of_stretches_are_compared_each_with_its_own():
    rnd = random.Random(8)
    rows, want = [], []
    for _ in range(300):
        own = np.array([rnd.randrange(1 << 32) for _ in range(rnd.randrange(80))], np.uint32)
        other = own.copy() if rnd.random() < 0.8 else own[:0]
        for _ in range(rnd.randrange(5) if len(other) else 0):
            other[rnd.randrange(len(other))] = 7
        rows.append((own, other))
    own, other = (np.concatenate([r[side] for r in rows]) for side in (0, 1))
    ends = [np.concatenate([[0], np.cumsum([len(r[side]) for r in rows])]) for side in (0, 1)]
    for at, (mine, theirs) in zip(ends[0], rows, strict=False):
        want += [(at + a, at + b, s) for a, b, s in dedup.alike_stretches(mine, theirs, 20, 0.8)]
    assert want and dedup.alike_stretches(own, other, 20, 0.8, *ends) == want


def test_short_rows_that_share_an_id_with_long_ones(make_docs):
    """Windows of the long text do not fit the short one."""
    rows = fragment_rows(45, False, 45, pairs=40)
    want = set(dedup.repeated_passages(make_docs(rows)).collect())
    short = [(i, "a short text of a few words") for i, _ in rows]
    assert want and set(dedup.repeated_passages(make_docs(rows + short)).collect()) == want
