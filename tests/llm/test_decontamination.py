import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrorisk.llm.decontamination import (
    ItemIndex,
    build_index,
    drop_contaminated,
    find_leaks,
    question_and_answer,
)


def make_items(n, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    question = lambda: " ".join(rnd.choices(vocabulary, weights, k=rnd.randrange(8, 30)))
    return [(i, question(), " ".join(rnd.choices(vocabulary, k=4))) for i in range(n)]


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_retrieves_all_above_threshold(block):
    index = ItemIndex(make_items(200, 1), block=block)
    rnd = random.Random(2)
    for _ in range(150):
        terms = sorted(rnd.sample(range(len(index.postings)), rnd.randrange(1, 60)))
        threshold = rnd.choice([0.05, 0.1, 0.2, 0.35, 0.5])
        scores = Counter()
        for t in terms:
            for item, weight in zip(index.postings[t].items, index.postings[t].weights, strict=True):
                scores[item] += weight
        own = np.asarray(terms)
        blocks = index.promising(np.zeros(len(own), int), own, 1, threshold)
        got = {i for _, b in blocks for i, _ in index.above(terms, threshold, b)}
        assert got == {i for i, s in scores.items() if s >= threshold - 1e-12}


def test_planted_items_are_found(spark, make_docs, odd_rows):
    items = make_items(60, 3)
    benchmark = spark.createDataFrame(
        [(i, f"{q}. {a}.") for i, q, a in items] + [(900, None), (901, ""), (None, "x y z")],
        "item_id bigint, text string",
    )
    index = build_index(benchmark)
    rnd = random.Random(4)
    noise = lambda k: " ".join(f"n{rnd.randrange(500)}" for _ in range(k))
    rows, want = list(odd_rows), {}
    for i, q, a in items:
        rows.append((100 + i, f"{noise(rnd.randrange(0, 900))} {q.upper()}.\n{a}! {noise(rnd.randrange(400))}"))
        want[100 + i] = i
        rows.append((300 + i, f"{noise(50)} {' '.join(sorted(q.split()))} {noise(50)}"))
        rows.append((500 + i, f"{noise(50)} {q} {noise(200)}"))
    docs = make_docs(rows).withColumns({"item_id": F.lit("x"), "leaked": F.lit(1), "row": F.lit(2)})
    found = find_leaks(docs, index).collect()
    assert {r.doc_id: r.item_id for r in found if r.score > 0.9} == want
    # The question alone, or its words in another order, is no leak.
    assert not {r.doc_id for r in found} & set(range(500, 600))
    kept = drop_contaminated(docs, index)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {r.doc_id for r in found}
    assert find_leaks(make_docs([]), index).count() == 0
    nothing = build_index(benchmark.filter("item_id > 800"))
    assert find_leaks(docs, nothing).count() == 0 and drop_contaminated(docs, nothing).count() == len(rows)


def test_items_with_text_ids(spark, make_docs):
    items = spark.createDataFrame([("q-1", "one two three four five six seven. eight nine ten.")], "name string, body string")
    index = build_index(items, item_col="name", text_col="body")
    docs = make_docs([(1, "so one two three four five six seven. eight nine ten. then"), (2, "other words")])
    found = find_leaks(docs, index)
    assert dict(found.dtypes)["item_id"] == "string"
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(1, "q-1")]
    assert [r.doc_id for r in drop_contaminated(docs, index).collect()] == [2]


@pytest.mark.parametrize("columns", [{}, {"question_col": "q", "answer_col": "a"}])
def test_parts_of_an_index_find_what_the_whole_one_finds(spark, make_docs, columns):
    items = make_items(80, 5)
    benchmark = spark.createDataFrame(
        [(i, f"{q}. {a}.", q, a) for i, q, a in items] + [(90, None, None, None), (80 - 1, *["x y. z."] * 3)],
        "item_id bigint, text string, q string, a string",
    )
    rnd = random.Random(6)
    noise = lambda k: " ".join(f"w{rnd.randrange(300)}" for _ in range(k))
    docs = make_docs([(i, f"{noise(40)} {q}. {a}. {noise(60)}") for i, q, a in items] + [(500, noise(400))])
    whole = build_index(benchmark, **columns)
    parts = build_index(benchmark, most_bytes=2000, **columns)
    assert len(whole) == 1 and len(parts) > 3
    found = [sorted(map(tuple, find_leaks(docs, index).drop("passage_start").collect())) for index in (whole, parts)]
    assert len(found[0]) >= 70 and [r[:2] for r in found[0]] == [r[:2] for r in found[1]]
    np.testing.assert_allclose([r[2:] for r in found[0]], [r[2:] for r in found[1]])
    kept = [sorted(r.doc_id for r in drop_contaminated(docs, index).collect()) for index in (whole, parts)]
    assert kept[0] == kept[1]


def test_question_and_answer():
    assert question_and_answer("What is it? It is so.") == ("What is it?", "It is so.")
    assert question_and_answer("one sentence") == ("one sentence", "one sentence")
    assert question_and_answer("") == ("", "")
