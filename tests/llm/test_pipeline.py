import random

import corpus_pipeline
import pytest

from tests.llm.test_simhash import brute_components, brute_print


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus with planted copies, near copies, toxic documents and test items."""
    rnd = random.Random(9)
    words = lambda k: [f"w{rnd.randrange(3000)}" for _ in range(k)]
    bad = ["vileword", "nastyterm", "grumblefoe", "foulish"]
    items = [(i, " ".join(words(25)) + ". " + " ".join(words(6)) + ".") for i in range(20)]
    docs, labels, kinds = [], [], {}
    for i in range(600):
        own = words(rnd.randrange(30, 250))
        kinds[i] = "clean"
        if i % 10 == 3:
            for _ in range(4):
                own.insert(rnd.randrange(len(own)), rnd.choice(bad))
            kinds[i] = "toxic"
        text = " ".join(own)
        if i % 10 == 5:
            text, kinds[i] = f"{text[:90]} {items[i % 20][1]} {text[90:]}", "leak"
        docs.append((i, text))
        if i % 2:
            labels.append((i, int(kinds[i] == "toxic")))
    for i in range(0, 200, 10):
        docs.append((1000 + i, docs[i][1].upper()))
        kinds[1000 + i] = "copy"
        near = docs[i + 1][1].split() + ["changed"]
        docs.append((2000 + i, " ".join(near)))
        kinds[2000 + i] = "near"
    docs.append((9000, None))
    root = str(tmp_path_factory.mktemp("corpus"))
    full = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{root}/labels.parquet")
    return root, kinds


def simhash_copies(rows):
    """Ids that are not the least of their component: 3-word shingles, 3 bits, all pairs."""
    prints = {i: brute_print(text, 3) for i, text in rows}
    ids = sorted(prints)
    near = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    return {i for i, least in brute_components(near, ids).items() if i != least}


def test_planted_cases(spark, corpus):
    root, kinds = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns = docs.columns
    gone, near = {}, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "near_dedup":
            near = simhash_copies([(r.doc_id, r.text) for r in docs.collect()])
        kept = stage(spark, docs, root)
        assert kept.columns == columns
        before, after = ({r.doc_id for r in d.select("doc_id").collect()} for d in (docs, kept))
        gone[name] = before - after
        docs = kept
    of = lambda *k: {i for i, kind in kinds.items() if kind in k}
    assert len(gone["toxicity"] & of("toxic")) >= 0.95 * len(of("toxic"))
    assert len(gone["toxicity"] - of("toxic")) <= 6
    assert gone["exact_dedup"] == of("copy") - gone["toxicity"]
    assert gone["near_dedup"] == near
    assert near and near <= of("near")
    assert gone["decontamination"] == of("leak") - gone["toxicity"]


def test_run_packs_what_is_left(spark, corpus):
    root, kinds = corpus
    pieces = corpus_pipeline.run(spark, root).toPandas()
    left = set(pieces["doc_id"])
    assert 9000 in left and not {i for i, k in kinds.items() if k in ("copy", "leak")} & left
    assert pieces.groupby("sequence_id")["length"].sum().max() <= 2048
    assert (pieces.groupby("doc_id")["length"].sum() == pieces.groupby("doc_id")["doc_tokens"].first()).all()


def test_stages_of_an_empty_corpus(spark, tmp_path):
    root = str(tmp_path)
    for name, schema in (
        ("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        ("benchmark", "item_id bigint, text string"),
        ("labels", "doc_id bigint, toxic int"),
    ):
        spark.createDataFrame([], schema).write.parquet(f"{root}/{name}.parquet")
    assert corpus_pipeline.run(spark, root).count() == 0
