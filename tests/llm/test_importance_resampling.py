import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hydrorisk.llm import importance_resampling as resampling
from hydrorisk.llm.importance_resampling import drawn_documents, rank_highest, resample
from hydrorisk.session import settle

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text, longest):
    words = WORD.findall(lowered(text))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=10, least_words=20, seed=2024, buckets=10_000, longest=1):
    def counted(texts):
        return Counter(
            zlib.crc32(f.encode()) % buckets for text in texts for f in features(text, longest)[1]
        )

    s, t = counted(x for _, x in docs), counted(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        words, found = features(text, longest)
        weight = 0
        for f in found:
            b = zlib.crc32(f.encode()) % buckets
            ratio = (t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))
            weight += math.floor(1000 * math.log(ratio))
        name = "" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, weight + noise, None, len(words) >= least_words])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "don't", "éTÉ", "x1", "42", "ß", "naïve", "K", "the", "of"]
    return [" ".join(rng.choices(words, k=rng.randint(0, 60))) + rng.choice(["", ".", "\n\t", "—"]) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"percent": 37, "least_words": 3, "longest": 3, "buckets": 50, "seed": 7}])
def test_equals_brute_force(spark, make_docs, odd_rows, options, monkeypatch):
    monkeypatch.setattr(resampling, "SEGMENT_ROWS", 20)
    docs = [*enumerate(texts(1, 300), 100), *odd_rows]
    target = texts(2, 20) + [None, ""]
    targets = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    found = resample(make_docs(docs).repartition(5), targets, **options)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in found.dtypes} == {"bigint"}
    assert got(found) == brute(docs, target, **options)


def test_ranks_over_runs_and_segments_with_ties_and_repeats(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(40)]), rng.choice([5, 5, 5, 1, 2, 9])) for _ in range(3000)]
    # A third of all rows is one row repeated.
    rows += [(7, 5)] * 1500
    scored = settle(
        spark.createDataFrame(rows, "id bigint, score bigint")
        .repartition(9)
        .withColumn("at", F.monotonically_increasing_id())
    )
    found = rank_highest(scored, 4000, len(rows), segments=16).collect()
    ranked = sorted((r for r in found if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 4001))
    expected = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0]))[:4000]
    assert [(r["id"], r["score"]) for r in ranked] == expected
    assert len(found) == len(rows)


def test_segments_split_a_score_that_a_third_shares(spark):
    rows = [(i % 3, 5 if i % 3 == 0 else i) for i in range(6000)]
    scored = settle(
        spark.createDataFrame(rows, "id bigint, score bigint").withColumn("at", F.monotonically_increasing_id())
    )
    samples = resampling._regular_samples(scored.sortWithinPartitions(*resampling._order()), 10)
    splitters = [samples[len(samples) * k // 8] for k in range(1, 8)]
    dealt = resampling._cut(scored.sortWithinPartitions(*resampling._order()), splitters)
    counts = [r["count"] for r in dealt.groupBy("segment").count().collect()]
    assert len(counts) == 8 and max(counts) < 2 * 6000 / 8


def test_empty_tables_and_clashing_names(spark, make_docs):
    target = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert resample(make_docs([]), target).collect() == []
    rows = [(f"k{i}", "a b c d " * 6, 1, 2, 3) for i in range(30)]
    docs = spark.createDataFrame(rows, "id string, score string, at int, rank int, segment int")
    none = spark.createDataFrame([], "id string, score string")
    ranks = resample(docs, none, id_column="id", column="score")
    assert sorted(r["rank"] for r in ranks.collect() if r["rank"]) == [1, 2, 3]
    drawn = drawn_documents(docs, ranks, id_column="id")
    assert drawn.columns == docs.columns and drawn.count() == 3
