import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hydrorisk.llm import conversation_repair as repair
from hydrorisk.llm.conversation_repair import (
    audit_conversations,
    damage_conversations,
    repair_conversations,
    repaired_digests,
)

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WHITE = " \t\n\x0b\f\r"


def legal(initials):
    body = initials.removeprefix("s")
    return initials == "" or (body != "" and body == "ua" * (len(body) // 2))


def all_audits(rows):
    """Every legal audit with up to two inserts at a place: (cost, audit, repaired rows)."""
    inserts = ["", "u", "a", "uu", "ua", "au", "aa"]
    for places in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product("KDua", repeat=len(rows)):
            cost, audit, out = 0, "", []
            for i in range(len(rows) + 1):
                for role in places[i]:
                    cost, audit = cost + 5, audit + "I"
                    out.append(({"u": "user", "a": "assistant"}[role], ""))
                if i == len(rows):
                    continue
                (role, text), fault, edit = rows[i][0], rows[i][1], edits[i]
                if edit == "D":
                    cost, audit = cost + 2, audit + "D"
                    continue
                if fault in ("blank", "duplicate"):
                    break
                cost += 5 if fault == "truncated" else 0
                if edit == "K":
                    audit += "K"
                else:
                    cost, audit, role = cost + 1, audit + "R", {"u": "user", "a": "assistant"}[edit]
                out.append((role, text))
            else:
                if legal("".join(role[:1] or "-" for role, _ in out)):
                    yield cost, audit, out


def faults(rows):
    seen, named = set(), []
    for row in rows:
        text = row[1].strip(WHITE)
        if not text:
            named.append((row, "blank"))
        elif row in seen:
            named.append((row, "duplicate"))
        else:
            named.append((row, "truncated" if text[-1] not in ".!?" else None))
        seen.add(row)
    return named


def in_order(rows):
    """(turn, role, text) as the operator orders them, NULLs as one space."""
    known = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(
        known, key=lambda k: (k[0] is not None, k[0] or 0, k[1].encode(), hashlib.md5(k[2].encode()).digest())
    )


def brute(rows):
    """The expected row of one conversation, by trying all edits."""
    known = in_order(rows)
    named = faults([(r, x) for _, r, x in known])
    cost, audit, out = min(all_audits(named), key=lambda a: a[:2])
    turns = {t for t, _, _ in known if t is not None}
    pairs = zip(known, known[1:], strict=False)
    text = "\n".join(f"{r}:{x}" for r, x in out)
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *[sum(f == kind for _, f in named) for kind in ("blank", "duplicate", "truncated")],
        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs),
        cost,
        audit,
        hashlib.sha256(text.encode()).hexdigest(),
    )


def result(rows, **kw):
    audits = audit_conversations(rows, **kw)
    found = repaired_digests(rows, audits, **kw).collect()
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: tuple(r)[1:] for r in found}


def test_equals_all_edits_tried(spark):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None]
    texts = ["One.", "two", "", " \n", "Three!", None, "é…", "Why? "]
    rows, expected = [], {}
    for conv in range(90):
        one = [
            (rng.choice([None, 0, 1, 2, 5]), rng.choices(roles, [5, 5, 2, 1, 1, 1])[0], rng.choice(texts))
            for _ in range(3 if conv % 9 == 0 else rng.randint(1, 2))
        ]
        expected[conv] = brute(one)
        rows += [(conv, *row) for row in one]
    rng.shuffle(rows)
    assert result(spark.createDataFrame(rows, SCHEMA)) == expected


@pytest.mark.parametrize("block", [2, 64])
def test_a_conversation_over_many_tasks_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for conv, n in ((1, 900), (2, 3), (None, 400), (3, 0)):
        for turn in range(n):
            role = rng.choice(["user", "assistant", "assistant", "system"])
            rows.append((conv, turn * 2, role, rng.choice(["Yes.", "no", "", f"text {turn}.", "a?"])))
    found = result(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert set(found) == {1, 2, None}
    for conv in (1, None):
        mine = [r[1:] for r in rows if r[0] == conv]
        named = faults([(r, x) for _, r, x in in_order(mine)])
        coded = [
            (r[:1], {None: 0, "blank": 1, "duplicate": 2, "truncated": 3}[f]) for (r, _), f in named
        ]
        # One agenda over the whole conversation, without blocks or tasks.
        ((cost, audit),) = repair.lightest(coded, 0, goal=True).values()
        assert found[conv][5:7] == (cost, audit)
        assert found[conv][0] == len(mine) - 1


def test_repaired_texts_are_legal_and_match_their_digest(spark):
    rows = spark.createDataFrame(
        [
            (1, 0, "system", "Be kind."),
            (1, 1, "assistant", "Hello there."),
            (1, 1, "assistant", "Hello there."),
            (1, 2, "assistant", "cut off"),
            (2, 0, "user", "Lone question?"),
            (3, 0, "user", ""),
        ],
        SCHEMA,
    )
    audits = audit_conversations(rows)
    found = [tuple(r) for r in repair_conversations(rows, audits).orderBy("conv_id", "place").collect()]
    # The system row becomes the question of the first answer; the rest goes.
    assert {r.conv_id: (r.cost, r.audit) for r in audits.collect()} == {
        1: (5, "RKDD"),
        2: (2, "D"),
        3: (2, "D"),
    }
    lines = {}
    for conv, place, role, text, _ in found:
        assert place == len(lines.setdefault(conv, []))
        lines[conv].append(f"{role}:{text}")
    for conv, digest in repaired_digests(rows, audits).select("conv_id", "repaired_sha256").collect():
        kept = lines.get(conv, [])
        assert legal("".join(line[0] for line in kept))
        assert digest == hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_damage_by_rule(spark):
    rows = [(c, t, "assistant", "One. Two? Three!") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    expected = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else "One Two Three" if code == 2 and conv is not None else text
        one = (conv, turn, "user" if code == 4 else role, text, code == 0)
        expected += [one] * (2 if code == 3 else 1)
    found = damage_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def test_dropped_rows_only_name_their_conversation(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a."), (2, 0, "user", "A?"), (2, 1, "assistant", "b.")], SCHEMA)
    found = result(rows, present=F.col("conv_id") == 2)
    nothing = hashlib.sha256(b"").hexdigest()
    assert found[1] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert found[2][5:7] == (0, "KK")


def test_empty_table_clashing_names_and_text_ids(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == {}
    rows = spark.createDataFrame(
        [("x", 0, "user", "a?", 1, 2, 3), ("x", 1, "assistant", "b.", 1, 2, 3)],
        "key string, place bigint, kind string, audit string, digest int, present int, cost int",
    )
    found = result(rows, names=("key", "place", "kind", "audit"))
    assert found["x"][5:7] == (0, "KK")
