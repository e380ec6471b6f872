import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hydrorisk.llm.exact_dedup import drop_exact_copies, exact_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    result = []
    for i, t in rows:
        text = (t or "").translate(LOWER)
        ids = [x for x in groups[text] if x is not None]
        best = keep(ids) if ids else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        result.append((i, best, len(groups[text]), i == best, sha))
    return sorted(result, key=str)


@pytest.mark.parametrize("bits", [128, 8])
@pytest.mark.parametrize("name, keep", [("smallest", min), ("largest", max)])
def test_groups(make_docs, odd_rows, name, keep, bits):
    """Eight bits make different texts share a hash; their bytes keep them apart."""
    rows = odd_rows + [(100 + i, f"text {i % 90}") for i in range(400)]
    found = exact_dedup(make_docs(rows), keep=name, hash_bits=bits).collect()
    assert sorted(map(tuple, found), key=str) == expected(rows, keep)


def test_keeps_one_of_each(make_docs, odd_rows):
    rows = odd_rows + [(200 + i, "hot copy") for i in range(300)]
    docs = make_docs(rows).withColumns({"hash": F.lit("x"), "keep_id": F.lit(7), "row": F.lit(1)})
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    texts = [(r.text or "").translate(LOWER) for r in kept.collect()]
    assert sorted(texts) == sorted({(t or "").translate(LOWER) for _, t in rows})
    assert {r.doc_id for r in kept.collect()} >= {1, 3, 4, 6, 8, 9, 200}


def test_empty(make_docs):
    assert exact_dedup(make_docs([])).count() == 0
    assert drop_exact_copies(make_docs([])).count() == 0
