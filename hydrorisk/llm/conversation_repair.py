"""Conversation structure repair by Knuth's lightest-derivation agenda.

A conversation is legal if its role initials read ``(s?(ua)+)?``. Edits make it so: Keep a
row (free; 5 more if truncated), Rerole it to user or assistant (1; 5 more if truncated),
Delete it (2; blank and duplicate rows must go), Insert an empty user or assistant row (5).
The audit of a repair is the initials of its edits; of the cheapest repairs the one whose
audit is least in ASCII order is taken.

Items of the deduction are "rows i to j lead from state p to state q", worth (cost, audit).
Rows are axioms; a deduction adds an edit to an item, or joins two items. Both append, so a
value never falls below its antecedents' and a lighter antecedent never gives a heavier
conclusion: among values of one item an audit is never the beginning of another of the same
cost, as only inserts could follow and they cost. Items are popped lightest first, and final
once popped.

A conversation may hold any share of all rows. Rows are range-partitioned by (conversation,
turn, ...), so a long one lies in several tasks. Each task finalises the items of blocks of
``BLOCK`` rows, joins them pairwise, and hands on one small table per conversation; the tables
of a conversation are joined in order. Texts cross one shuffle only, when the audits are known.

Defined results: conversations without any row cost 0 with an empty audit. NULL role and text
count as one space, NULL turns come first, the NULL id is one conversation. Rows of one turn
are ordered by role, then by MD5 of the text; texts of one MD5 count as equal. Repeated rows
are duplicates. An empty table gives an empty result. Other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of a block, whose items one agenda finalises; the result does not depend on it.
BLOCK = 64

# Costs of the edits, white space, ends of sentences.
RETYPE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
SPACE = " \t\n\x0b\f\r"
ENDS = ".!?"
# Faults of a row, and the mark of one that only names its conversation.
NONE, BLANK, DUPLICATE, TRUNCATED, ABSENT = 0, 1, 2, 3, 4
# States: nothing yet, after the system row, after a user row, after an assistant row.
STATES = range(4)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
# The one role that may follow in each state by rerole or insert.
FOLLOWS = ("user", "user", "assistant", "user")
AFTER = tuple(STEP[q, FOLLOWS[q][0]] for q in STATES)
LEGAL = (0, 3)

# Lightest (cost, audit) by (first state, last state).
Items = dict[tuple[int, int], tuple[int, str]]


def lightest(rows: list[tuple[str, int]], start: int, goal: bool = False) -> Items:
    """Lightest items that lead over all ``rows`` (initial, fault) from ``start``.

    With ``goal`` the agenda ends with the first legal one, which is then the lightest.
    """
    found: Items = {}
    final = set()
    agenda = [(0, "", 0, start)]
    while agenda:
        cost, audit, i, q = heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        heappush(agenda, (cost + INSERT, audit + "I", i, AFTER[q]))
        if i == len(rows):
            if not goal:
                found[start, q] = cost, audit
            elif q in LEGAL:
                return {(start, q): (cost, audit)}
            continue
        initial, fault = rows[i]
        heappush(agenda, (cost + DELETE, audit + "D", i + 1, q))
        if fault in (BLANK, DUPLICATE):
            continue
        more = CUT_OFF if fault == TRUNCATED else 0
        kept = STEP.get((q, initial))
        if kept is not None:
            heappush(agenda, (cost + more, audit + "K", i + 1, kept))
        heappush(agenda, (cost + RETYPE + more, audit + "R", i + 1, AFTER[q]))
    return found


def joined(left: Items, right: Items) -> Items:
    """Items over two neighbouring stretches of rows."""
    found: Items = {}
    for (p, q), (cost, audit) in left.items():
        for (r, s), (more, rest) in right.items():
            if q == r:
                value = cost + more, audit + rest
                if (p, s) not in found or value < found[p, s]:
                    found[p, s] = value
    return found


class _Run:
    """The rows of one conversation in one task: counts, and the items of its full blocks."""

    def __init__(self, conversation: object, first: bool):
        self.conversation, self.first_of_task = conversation, first
        self.rows: list[tuple[str, int]] = []
        self.blocks: list[tuple[int, Items]] = []
        self.faults = [0] * 5
        self.illegal = 0
        self.initials: tuple[str | None, str | None] = (None, None)
        self.turns: tuple[int | None, int | None, int] = (None, None, 0)

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if fault == ABSENT:
            return
        self.faults[fault] += 1
        first, last = self.initials
        self.illegal += last is not None and last + initial not in ("su", "ua", "au")
        self.initials = initial if first is None else first, initial
        if turn is not None:
            low, high, n = self.turns
            self.turns = turn if low is None else low, turn, n + (turn != high)
        self.rows.append((initial, fault))
        if len(self.rows) == BLOCK:
            self._close_block()

    def _close_block(self) -> None:
        starts = STATES if self.first_of_task or self.blocks else [0]
        items: Items = {}
        for start in starts:
            items |= lightest(self.rows, start)
        size, self.rows = 0, []
        while self.blocks and self.blocks[-1][0] == size:
            items, size = joined(self.blocks.pop()[1], items), size + 1
        self.blocks.append((size, items))

    def piece(self, last: bool) -> tuple:
        """What the other tasks' pieces of the conversation are joined with."""
        if not self.blocks and not self.first_of_task and not last:
            items = lightest(self.rows, 0, goal=True)
        else:
            if self.rows or not self.blocks:
                self._close_block()
            items = self.blocks.pop()[1]
            while self.blocks:
                items = joined(self.blocks.pop()[1], items)
        table = [
            {"start": p, "end": q, "cost": cost, "audit": audit}
            for (p, q), (cost, audit) in items.items()
        ]
        return (*self.faults[1:4], self.illegal, *self.initials, *self.turns, table)


_PIECE = (
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string,"
    " low bigint, high bigint, turns bigint,"
    " items array<struct<start:int,end:int,cost:bigint,audit:string>>"
)
_AUDIT = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint,"
    " audit string"
)
_ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "string": pa.string(),
    "items": pa.list_(
        pa.struct(
            [("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]
        )
    ),
}
# Rows of a batch that a task hands on.
_BATCH = 4096


def _fields(schema: str) -> list[tuple[str, pa.DataType]]:
    fields = T.StructType.fromDDL(schema).fields
    return [(f.name, _ARROW.get(f.dataType.simpleString(), _ARROW["items"])) for f in fields]


def _batches(
    rows: Iterable[tuple], keys: list[pa.Field], fields: list[tuple[str, pa.DataType]]
) -> Iterator[pa.RecordBatch]:
    """Rows (keys, fields) in batches of bounded size."""
    arrow = pa.schema([*keys, *fields])
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        arrays = [pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=arrow)

    for row in rows:
        held.append(row)
        if len(held) == _BATCH:
            yield batch()
            held.clear()
    if held:
        yield batch()


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _keyed(rows: DataFrame, schema: str, *columns: str) -> T.StructType:
    kept = [rows.schema[c] for c in ("key", *columns)]
    return T.StructType([*kept, *T.StructType.fromDDL(schema).fields])


def _pieces(rows: DataFrame) -> DataFrame:
    """One piece per conversation and task, of rows in order: (key, part, _PIECE)."""
    schema = f"part int, {_PIECE}"
    fields = _fields(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = next(batches, None)
        if first is None:
            return

        def pieces() -> Iterator[tuple]:
            current = None
            for conversation, turn, initial, fault in _listed(_chained(first, batches)):
                if current is None or conversation != current.conversation:
                    if current is not None:
                        yield current.conversation, part, *current.piece(last=False)
                    current = _Run(conversation, first=current is None)
                current.add(turn, initial, fault)
            if current is not None:
                yield current.conversation, part, *current.piece(last=True)

        yield from _batches(pieces(), [first.schema.field(0)], fields)

    return rows.mapInArrow(run, _keyed(rows, schema))


def _chained(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


class _Whole:
    """A conversation that is joined from its pieces, in order."""

    def __init__(self, conversation: object):
        self.conversation = conversation
        self.counts = [0] * 4
        self.tail = self.low = self.high = None
        self.turns = 0
        self.items: Items = {(0, 0): (0, "")}

    def add(self, counts: tuple, head: str | None, tail: str | None, turns: tuple, items: list) -> None:
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        if head is not None:
            self.counts[3] += self.tail is not None and self.tail + head not in ("su", "ua", "au")
            self.tail = tail
        low, high, n = turns
        if low is not None:
            self.turns += n - (low == self.high)
            self.low = low if self.low is None else self.low
            self.high = high
        table = {(i["start"], i["end"]): (i["cost"], i["audit"]) for i in items}
        self.items = joined(self.items, table)

    def result(self) -> tuple:
        cost, audit = min(self.items[0, q] for q in LEGAL if (0, q) in self.items)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conversation, gaps, *self.counts, cost, audit


def _wholes(pieces: DataFrame) -> DataFrame:
    """The audit of every conversation, from its pieces in order."""
    fields = _fields(_AUDIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        def wholes() -> Iterator[tuple]:
            current = None
            for row in _listed(_chained(first, batches)):
                conversation, _, *counts, head, tail, low, high, turns, items = row
                if current is None or conversation != current.conversation:
                    if current is not None:
                        yield current.result()
                    current = _Whole(conversation)
                current.add(counts, head, tail, (low, high, turns), items)
            if current is not None:
                yield current.result()

        yield from _batches(wholes(), [first.schema.field(0)], fields)

    return pieces.mapInArrow(run, _keyed(pieces, _AUDIT))


def _ordered(rows: DataFrame, names: tuple[str, str, str, str], present: Column) -> DataFrame:
    """Working columns: key, turn, role, digest of the text, text, present."""
    conversation, turn, role, text = (F.col(f"`{name}`") for name in names)
    spoken = F.coalesce(text.cast("string"), F.lit(" "))
    return rows.select(
        conversation.alias("key"),
        turn.cast("bigint").alias("turn"),
        F.coalesce(role.cast("string"), F.lit(" ")).alias("role"),
        F.unhex(F.md5(spoken.cast("binary"))).alias("digest"),
        spoken.alias("text"),
        present.alias("present"),
    )


_NAMES = ("conv_id", "turn", "role", "text")


def audit_conversations(
    rows: DataFrame, names: tuple[str, str, str, str] = _NAMES, present: Column | None = None
) -> DataFrame:
    """One row per conversation: id, gaps, faults by kind, illegal pairs, cost and audit of the repair.

    ``names`` are the columns of conversation, turn, role and text. Rows that are not
    ``present`` only name their conversation. Of a row's faults the first counts: blank,
    duplicate (role and text seen earlier), truncated. ``gaps`` are turn numbers missing
    between the least and the largest; ``illegal`` counts neighbours other than su, ua, au.
    """
    held = F.lit(True) if present is None else present
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    seen = Window.partitionBy("key", "present", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    lean = _ordered(rows, names, held).select(
        "key",
        "turn",
        "role",
        "digest",
        "present",
        F.when(trimmed == "", BLANK)
        .when(F.instr(F.lit(ENDS), F.right(trimmed, F.lit(1))) > 0, NONE)
        .otherwise(TRUNCATED)
        .alias("own"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("key", "turn", "role", "digest")]
    marked = (
        lean.withColumn("again", F.row_number().over(seen) > 1)
        .select(
            "key",
            "turn",
            "role",
            "digest",
            F.when(~F.col("present"), ABSENT)
            .when((F.col("own") != BLANK) & F.col("again"), DUPLICATE)
            .otherwise(F.col("own"))
            .alias("fault"),
        )
        .repartitionByRange(*order)
        .sortWithinPartitions(*order, F.col("fault") == DUPLICATE)
    )
    pieces = _pieces(marked.select("key", "turn", F.left("role", F.lit(1)).alias("initial"), "fault"))
    in_order = pieces.repartition("key").sortWithinPartitions(F.col("key").asc_nulls_first(), "part")
    return _wholes(in_order).withColumnRenamed("key", names[0])


def _beside_audits(
    rows: DataFrame, audits: DataFrame, names: tuple[str, str, str, str], present: Column | None
) -> DataFrame:
    """Audits and rows of a conversation in one task: first the audit, then the rows in order."""
    held = F.lit(True) if present is None else present
    texts = _ordered(rows, names, held).filter("present")
    kinds = dict(texts.dtypes)
    first = audits.select(
        F.col(f"`{names[0]}`").alias("key"),
        F.lit(0).alias("kind"),
        F.struct(*[c for c in audits.columns if c != names[0]]).alias("summary"),
        *[F.lit(None).cast(kinds[c]).alias(c) for c in ("turn", "role", "digest", "text")],
    )
    nothing = F.lit(None).cast(first.schema["summary"].dataType).alias("summary")
    then = texts.select(
        "key", F.lit(1).alias("kind"), nothing, "turn", "role", "digest", "text"
    )
    order = [F.col(c).asc_nulls_first() for c in ("key", "kind", "turn", "role", "digest")]
    both = first.unionByName(then).repartition("key").sortWithinPartitions(*order)
    return both.select("key", "kind", "summary", "role", "text")


class _Repair:
    """The edits of one conversation, carried out row by row."""

    def __init__(self, conversation: object, summary: dict):
        self.conversation, self.summary, self.audit = conversation, summary, summary["audit"]
        self.at, self.state = 0, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            role = FOLLOWS[self.state]
            self.at, self.state = self.at + 1, AFTER[self.state]
            yield role, "", "I"

    def take(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(role, text, edit) of what comes of the next row, and of inserts before it."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            role, self.state = FOLLOWS[self.state], AFTER[self.state]
        elif edit == "K":
            self.state = STEP[self.state, role[:1]]
        if edit != "D":
            yield role, text, edit


def _carried_out(rows: Iterable[tuple]) -> Iterator[tuple[_Repair, str | None, str, str]]:
    """(repair, role, text, edit) of every repaired row; a None role ends each conversation."""
    repair = None
    for conversation, kind, summary, role, text in rows:
        if kind == 0:
            if repair is not None:
                yield from ((repair, *row) for row in repair.inserted())
                yield repair, None, "", ""
            repair = _Repair(conversation, summary)
        else:
            yield from ((repair, *row) for row in repair.take(role, text))
    if repair is not None:
        yield from ((repair, *row) for row in repair.inserted())
        yield repair, None, "", ""


_REPAIRED = "place bigint, role string, text string, edit string"


def repair_conversations(
    rows: DataFrame,
    audits: DataFrame,
    names: tuple[str, str, str, str] = _NAMES,
    present: Column | None = None,
) -> DataFrame:
    """The repaired conversations: id, place (from 0), role, text and edit (K, R or I) of every row.

    ``audits`` is ``audit_conversations`` of the same rows. A task streams through its
    conversations and holds one batch of texts and one audit at a time.
    """
    both = _beside_audits(rows, audits, names, present)
    fields = _fields(_REPAIRED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        def repaired() -> Iterator[tuple]:
            place = 0
            for repair, role, text, edit in _carried_out(_listed(_chained(first, batches))):
                if role is None:
                    place = 0
                else:
                    yield repair.conversation, place, role, text, edit
                    place += 1

        yield from _batches(repaired(), [first.schema.field(0)], fields)

    done = both.mapInArrow(run, _keyed(both, _REPAIRED))
    return done.withColumnRenamed("key", names[0])


def repaired_digests(
    rows: DataFrame,
    audits: DataFrame,
    names: tuple[str, str, str, str] = _NAMES,
    present: Column | None = None,
) -> DataFrame:
    """``audits`` with the SHA-256 of each repaired conversation's ``role:text``, newline-joined.

    A digest reads its conversation in order, so one task streams through it; it holds one
    batch of texts at a time.
    """
    both = _beside_audits(rows, audits, names, present)
    schema = "repaired_sha256 string"
    fields = _fields(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        def digests() -> Iterator[tuple]:
            digest, between = hashlib.sha256(), ""
            for repair, role, text, _ in _carried_out(_listed(_chained(first, batches))):
                if role is None:
                    yield repair.conversation, repair.summary, digest.hexdigest()
                    digest, between = hashlib.sha256(), ""
                else:
                    digest.update(f"{between}{role}:{text}".encode())
                    between = "\n"

        kept = [first.schema.field(c) for c in ("key", "summary")]
        yield from _batches(digests(), kept, fields)

    done = both.mapInArrow(run, _keyed(both, schema, "summary"))
    return done.select(F.col("key").alias(names[0]), "summary.*", "repaired_sha256")


def damage_conversations(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults planted by CRC-32 of ``conv_id:turn``, mod 20.

    0 takes the row away (``dropped``; it still names its conversation), 1 empties its text,
    2 removes its ends of sentences, 3 repeats it, 4 makes it the user's. NULL counts as
    one space.
    """
    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    coded = rows.select(
        "conv_id", "turn", known("role").alias("role"), known("text").alias("text"), code.alias("_code")
    )
    code = F.col("_code")
    return coded.select(
        "conv_id",
        "turn",
        F.when(code == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(code == 1, "").when(code == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        (code == 0).alias("dropped"),
        F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
