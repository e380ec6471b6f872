import hashlib
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from hydrorisk.llm.components import components
from hydrorisk.llm.simhash import drop_simhash_copies, hamming_links, simhash_components


def brute_print(text, words):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    parts = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near_texts(seed, count=60):
    rnd = random.Random(seed)
    base = [[f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(1, 200))] for _ in range(12)]
    texts = []
    for i in range(count):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(50)}"
        texts.append((i, " ".join(words)))
    return texts


def test_matches_brute_force(make_docs, odd_rows):
    rows = odd_rows + [(100 + i, t) for i, t in near_texts(3)]
    docs = make_docs(rows).withColumns({"fingerprint": F.lit("x"), "a": F.lit(1), "id": F.lit(2)})
    prints = [brute_print(t, 3) for _, t in rows]
    near = [
        (a, b)
        for a in range(len(rows))
        for b in range(a)
        if (prints[a] ^ prints[b]).bit_count() <= 3
    ]
    root = brute_components(near, range(len(rows)))
    least = {}
    for n, r in root.items():
        if rows[n][0] is not None:
            least[r] = min(least.get(r, 10**9), rows[n][0])
    want = Counter((i, f"{p:016x}", least.get(root[n])) for n, ((i, _), p) in enumerate(zip(rows, prints, strict=True)))
    got = Counter(map(tuple, simhash_components(docs, words=3, distance=3).collect()))
    assert got == want
    assert simhash_components(make_docs([])).count() == 0


@pytest.mark.parametrize("distance, segments", [(3, 2), (3, 4), (2, 2), (5, 3)])
def test_every_link_once(spark, distance, segments):
    rnd = random.Random(distance)
    values = set()
    for _ in range(40):
        value = rnd.getrandbits(64)
        for _ in range(6):
            values.add(value)
            value ^= 1 << rnd.randrange(64)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    prints = spark.createDataFrame([(v,) for v in values], "fingerprint bigint")
    got = sorted(map(tuple, hamming_links(prints, distance, segments).collect()))
    mask = (1 << 64) - 1
    want = sorted(
        (a, b) for a in values for b in values if a < b and ((a ^ b) & mask).bit_count() <= distance
    )
    assert got == want


def test_components_of_paths_and_stars(spark):
    rnd = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 80)]
    links += [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    want = brute_components(links, {n for a, b in links if a != b for n in (a, b)})
    got = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.node: r.least for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_of_each_component_stays(make_docs, odd_rows):
    rows = odd_rows + [(100 + i, t) for i, t in near_texts(8)] + [(100, "other text of the id"), (None, "odd")]
    docs = make_docs(rows).withColumns({"label": F.lit("x"), "id": F.lit(1), "row": F.lit(2), "digest": F.lit(3)})
    prints = [brute_print(t, 3) for _, t in rows]
    near = [
        (a, b)
        for a in range(len(rows))
        for b in range(a)
        if (prints[a] ^ prints[b]).bit_count() <= 3
    ]
    root = brute_components(near, range(len(rows)))
    want = {}
    for n, (i, t) in enumerate(rows):
        digest = hashlib.md5((t or "").encode()).hexdigest()
        row = (i is None, i or 0, digest, i, t)
        want[root[n]] = min(want.get(root[n], row), row, key=lambda r: r[:3])
    kept = drop_simhash_copies(docs, words=3, distance=3)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text or "") for r in kept.collect()]
    assert sorted(got, key=repr) == sorted(((r[3], r[4] or "") for r in want.values()), key=repr)
    assert drop_simhash_copies(make_docs([])).count() == 0
