import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hydrorisk.llm.packing import WordIds, combinations, pack, packing_plan, repeat_counts
from hydrorisk.llm.token_counts import PieceCounter, token_counts

ALPHABET = (
    "abc XYZ  \n\t\r '’s don't 123 ²½ _-!?.,;: éÉßøŒſŉǆȺȾɎ İı ªº ñ – “x” … "
    "日本語 한국 ω Σς \u0301 \u00a0 \u2003 \x1c \x85 🙂 <|endoftext|> <|startoftext|> 's 'LL"
)


def random_texts(n=400):
    rnd = random.Random(4)
    parts = ALPHABET.split(" ") + [" ", "  ", "\n", "\n\n", "Hello", "thér", "'", "''", "7", "00"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("memory", [5, 10**6])
def test_piece_counts_equal_the_library(memory):
    texts = random_texts()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert PieceCounter("byte_bpe_50k.json", memory).counts(texts) == want


@pytest.mark.parametrize("memory", [5, 10**6])
def test_word_ids_equal_the_library(memory):
    texts = random_texts()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(b, "<u4").tolist() for b in WordIds("word_bpe_49k.json", memory).of(texts)]
    assert got == want


def test_words_are_asked_of_the_model_alone(monkeypatch):
    text = "Don't caf\xe9 \xc9\xd8\u0161\u0233 12\xbd \u2013 \u201cx\u201d \xa1\xab!? \xb5"
    want = WordIds("word_bpe_49k.json").tokenizer.encode(text, add_special_tokens=False).ids
    words = WordIds("word_bpe_49k.json")
    monkeypatch.setattr(words, "tokenizer", None)
    assert [np.frombuffer(b, "<u4").tolist() for b in words.of([text, "", text])] == [want, [], want]


def test_token_counts_of_odd_rows(make_docs, odd_rows):
    rows = odd_rows + [(50 + i, t) for i, t in enumerate(random_texts(50))]
    docs = make_docs(rows).withColumns({"id": F.lit("x"), "n_tokens": F.lit("y")})
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False))
        want.append((i, len((t or "").encode()), n, n > 512))
    got = [tuple(r) for r in token_counts(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts(make_docs([])).count() == 0


def padding(plan, window):
    return sum((window - sum(p)) * n for p, n in plan)


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    rnd = random.Random(seed)
    window = rnd.choice([16, 64, 256])
    histogram = {}
    for _ in range(rnd.randrange(1, 4000)):
        length = min(window, int(rnd.expovariate(4 / window)) + 1)
        histogram[length] = histogram.get(length, 0) + 1
    used = {}
    plan = packing_plan(histogram, window)
    for pattern, times in plan:
        assert sum(pattern) <= window and times > 0
        for length in pattern:
            used[length] = used.get(length, 0) + times
    assert used == histogram
    sequences = sum(n for _, n in plan)
    least = -(-sum(k * n for k, n in histogram.items()) // window)
    assert sequences <= least * 1.05 + 2


def test_repeat_counts_solve_a_known_mixture():
    window = 100
    parts = combinations([10, 30, 60, 90, 70], window)
    truth = np.arange(1, len(parts) + 1) * 10.0
    histogram = np.zeros(window + 1)
    for pattern, x in zip(parts, truth, strict=True):
        for length in pattern[pattern > 0]:
            histogram[length] += x
    solved = repeat_counts(parts, histogram, rounds=3000)
    made = np.zeros(window + 1)
    for pattern, x in zip(parts, solved, strict=True):
        for length in pattern[pattern > 0]:
            made[length] += x
    assert np.abs(made - histogram).max() < 0.5 and (solved >= 0).all()


def test_packed_documents_round_trip(make_docs, odd_rows):
    rows = odd_rows + [(100 + i, "tiny") for i in range(700)]
    docs = make_docs(rows).withColumns({"rank": F.lit("x"), "length": F.lit(1), "block": F.lit(2)})
    frame = pack(docs, window=256, with_ids=True).toPandas()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(
        (str(i), library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows
    )
    got, open_docs = [], {}
    for r in frame.sort_values(["start"]).itertuples():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        key = "None" if r.doc_id != r.doc_id else str(int(r.doc_id))
        open_docs.setdefault((key, r.doc_tokens, r.start), []).append(ids)
    for (key, total, start), pieces in sorted(open_docs.items(), key=lambda x: x[0][2]):
        for ids in pieces:
            if start == 0:
                got.append([key, list(ids), total])
            else:
                next(g for g in got if g[0] == key and g[2] == total and len(g[1]) == start)[1].extend(ids)
    assert sorted((k, ids) for k, ids, _ in got) == want
    for _, part in frame.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]]
        assert part["length"].sum() <= 256
    ids = set(frame["sequence_id"])
    assert ids == set(range(len(ids)))
    assert pack(make_docs([])).count() == 0
