import random

from pyspark.sql import functions as F

from hydrorisk.llm.toxicity import drop_toxic, fit_toxicity, score_toxicity, train_model, windows

BAD = ["vileword", "nastyterm", "grumblefoe", "slurry", "foulish"]


def texts(n, seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdefghilmnoprstu", k=rnd.randrange(2, 9))) for _ in range(900)]
    made = []
    for i in range(n):
        words = rnd.choices(vocabulary, k=rnd.randrange(20, 200))
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        made.append((" ".join(words), int(toxic)))
    return made


def test_held_out_accuracy():
    examples = texts(1200, 1)
    model = train_model(examples[:800])
    held = examples[800:]
    scores = model.scores([t for t, _ in held])
    right = [(s >= 0.7) == bool(y) for s, (_, y) in zip(scores, held, strict=True)]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= s <= 1 for s in scores)
    assert model.scores([held[0][0]]) == [scores[0]]


def test_windows_cover_whole_texts():
    assert windows("") == set() and windows(" \n") == set()
    text = "Word " * 5000 + "vileword " + "x" * 95
    found = windows(text)
    assert any(b"vileword" in w for w in found) and sum(w.count(b"x") for w in found) == 40 + 15
    assert len(found) == 5 - 1


def test_one_class_and_none():
    for examples in ([], [("a b", 1)], [("a b", 0), ("c", 0)]):
        model = train_model(examples)
        scores = model.scores(["", "a b c"])
        assert scores[0] == scores[1] and 0 < scores[0] < 1


def test_spark_scores(spark, make_docs, odd_rows):
    examples = texts(300, 2)
    rows = [(1000 + i, t) for i, (t, _) in enumerate(examples)] + odd_rows
    docs = make_docs(rows).withColumns({"score": F.lit("x"), "value": F.lit("y")})
    labels = spark.createDataFrame(
        [(1000 + i, y) for i, (_, y) in enumerate(examples)] + [(1, None), (None, 1), (4, 7)],
        "doc_id bigint, toxic int",
    )
    model = fit_toxicity(docs, labels)
    scored = score_toxicity(docs, model)
    assert scored.columns == [c for c in docs.columns if c != "score"] + ["score"]
    got = {(r.doc_id, r.text): r.score for r in scored.collect()}
    want = model.scores([t or "" for _, t in rows])
    assert all(abs(got[row] - w) < 1e-12 for row, w in zip(rows, want, strict=True))
    assert score_toxicity(make_docs([]), model).count() == 0
    clean = drop_toxic(docs, model, 0.7)
    assert clean.columns == docs.columns
    assert clean.count() == sum(w < 0.7 for w in want)
    assert drop_toxic(docs, train_model([])).count() == len(rows)
    assert fit_toxicity(docs, labels, usable=F.col("doc_id") < 0).odds == {}
