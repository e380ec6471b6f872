import random

import pytest

from hydrorisk.llm.substring_dedup import repeated_passages


def fragment_rows(fragment, changed, seed, pairs=120):
    """Pairs that share 60 words, inside of which is a fragment that all documents share."""
    rnd = random.Random(seed)
    noise = lambda k: [f"n{rnd.randrange(10**7)}" for _ in range(k)]
    common = noise(fragment)
    rows = []
    for pair in range(pairs):
        before = rnd.randrange(60 - fragment + 1)
        passage = noise(before) + common + noise(60 - fragment - before)
        again = list(passage)
        if changed:
            again[rnd.randrange(8, 52)] = "changed"
        for i, own in ((2 * pair, passage), (2 * pair + 1, again)):
            text = noise(rnd.randrange(60)) + own + noise(rnd.randrange(60))
            rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("fragment, changed, least", [(45, False, 1.0), (40, True, 0.9)])
def test_passages_around_a_fragment_of_all_documents(make_docs, fragment, changed, least):
    rows = fragment_rows(fragment, changed, fragment)
    docs = make_docs(rows)
    found = repeated_passages(docs.repartition(1)).collect()
    pairs = {frozenset((r.doc_id, r.first_id)) for r in found}
    want = {frozenset((2 * p, 2 * p + 1)) for p in range(len(rows) // 2)}
    assert len(pairs & want) >= least * len(want)
    if not changed:
        assert pairs == want
    # However the documents are dealt to tasks.
    assert set(repeated_passages(docs.repartition(7)).collect()) == set(found)
