"""Repair of conversation structure at the least cost, in streams of sorted rows.

Rows are dealt out by conversation and sorted by turn, last turn first, and a task goes
once through its batches. The state it carries from batch to batch is the cost of
repairing all that follows, for each of four states of the wanted order of roles; every
row turns it into the next one and leaves a byte behind: the best edit in each of the
states. Followed from the first row on, these bytes give the cheapest edits, and of equally
cheap ones those whose initials come first.

A conversation of moderate size is held until its bytes are known and leaves the task
repaired. A giant one is not held: its rows are written out with their bytes, and a second
stream, first turn first, follows them. Both streams keep a few rows in memory however
long a conversation is. (The streams are ``mapInArrow``, the Arrow form of ``mapInPandas``,
in which turns that may be null stay integers.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from usageweave.llm.shared import stored

BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
USER, ASSISTANT = "user", "assistant"
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, STAYS_TRUNCATED = 1, 2, 5, 5
_EDITS = "DIKR"
_NEVER = 10**9

# States of the order ``(s?(ua)+)?``: at the start, after s, after u, after a.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The role a state lacks, and where that role leads.
_WANTED = {
    _START: (USER, _USER),
    _SYSTEM: (USER, _USER),
    _USER: (ASSISTANT, _ASSISTANT),
    _ASSISTANT: (USER, _USER),
}
#: Cost of what is left behind the last row, by state.
_END = (0, _NEVER, _NEVER, 0)


@dataclass(frozen=True)
class RepairOptions:
    #: Rows, and characters of text, of the largest conversation that a task holds.
    held_rows: int = 20_000
    held_chars: int = 16_000_000


def _kept(state: int, initial: str) -> int | None:
    """Where a role with this initial leads, if it is in order."""
    if initial == "s" and state == _START:
        return _SYSTEM
    role, then = _WANTED[state]
    return then if initial == role[0] else None


def _with_inserts(costs: tuple[int, ...]) -> tuple[int, ...]:
    """The costs if rows may be inserted first; two at most pay off."""
    out = []
    for state in range(4):
        once = _WANTED[state][1]
        twice = _WANTED[once][1]
        out.append(min(costs[state], INSERT + costs[once], 2 * INSERT + costs[twice]))
    return tuple(out)


@cache
def step(after: tuple[int, ...], initial: str, fault: str) -> tuple[tuple[int, ...], int, int]:
    """The costs before a row, less their least, from those behind it; that least cost; and
    the best edit in each state, two bits each.

    Costs of two states differ by a few edits at most, so there are few different arguments.
    """
    extra = STAYS_TRUNCATED if fault == TRUNCATED else 0
    deleted, kept, reroled = [], [], []
    for state in range(4):
        stays = fault not in (BLANK, DUPLICATE)
        then = _kept(state, initial) if stays else None
        deleted.append(DELETE + after[state])
        kept.append(_NEVER if then is None else extra + after[then])
        reroled.append(REROLE + extra + after[_WANTED[state][1]] if stays else _NEVER)
    before = _with_inserts(tuple(map(min, deleted, kept, reroled)))
    choices = 0
    for state in range(4):
        options = (
            deleted[state],
            INSERT + before[_WANTED[state][1]],
            kept[state],
            reroled[state],
        )
        choices |= options.index(before[state]) << 2 * state
    least = min(before)
    return tuple(c - least for c in before), least, choices


@dataclass
class _Row:
    """A row of a conversation that stands there ``n`` times in a row."""

    turn: int | None
    role: str
    text: str
    n: int
    fault: str
    choices: int = 0


def _edited(rows: Iterable[_Row]) -> Iterator[tuple]:
    """(place, edit, n, turn, old_role, role, text, fault, cost) for rows with their choices,
    in order.
    """
    state, place = _START, 0

    def inserted():
        role, then = _WANTED[state]
        return then, (place, "I", 1, None, None, role, "", "", INSERT)

    for row in rows:
        while (edit := _EDITS[row.choices >> 2 * state & 3]) == "I":
            state, out = inserted()
            yield out
            place += 1
        role, cost = row.role, STAYS_TRUNCATED if row.fault == TRUNCATED else 0
        if edit == "D":
            cost = DELETE
        elif edit == "R":
            role, state = _WANTED[state]
            cost += REROLE
        else:
            state = _kept(state, row.role[:1])
        yield place, edit, 1, row.turn, row.role, role, row.text, row.fault, cost
        place += 1
        if row.n > 1:
            fault = row.fault if row.fault == BLANK else DUPLICATE
            more = row.n - 1
            yield place, "D", more, row.turn, row.role, row.role, row.text, fault, DELETE * more
            place += more
    while _END[state]:
        state, out = inserted()
        yield out
        place += 1


_EDIT_FIELDS = [
    ("place", pa.int64()),
    ("edit", pa.string()),
    ("n", pa.int64()),
    ("turn", pa.int64()),
    ("old_role", pa.string()),
    ("role", pa.string()),
    ("text", pa.string()),
    ("fault", pa.string()),
    ("cost", pa.int64()),
]
_EDIT_TYPES = ", ".join(
    f"{name} {'string' if kind == pa.string() else 'long'}" for name, kind in _EDIT_FIELDS
)


class _Writer:
    """Rows gathered into batches of bounded size."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.chars = schema, [], 0

    def add(self, row: tuple, chars: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.chars += chars
        if len(self.rows) >= 10_000 or self.chars >= 8_000_000:
            yield self.batch()

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, self.schema)]
        self.rows, self.chars = [], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n and fault for ``rows`` (conv_id, turn, role, text, and n if
    a row stands for several equal ones): equal rows of a turn are one with their number.

    The fault is that of the first of them: blank if no character is left but white space,
    duplicate if an earlier turn has the same role and text, truncated if the last such
    character doesn't end a sentence, else empty. Null roles and texts are one space.
    """
    number = F.col("n") if "n" in rows.columns else F.lit(1)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        number.cast("long").alias("n"),
    )
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    content = F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text"), 256)
    trimmed = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    once = stored(
        once.select(
            "*",
            F.struct(F.col("turn").isNotNull().alias("known"), "turn").alias("at"),
            content.alias("content"),
            F.right(trimmed, F.lit(1)).alias("end"),
        ),
        "conversation-rows",
    )
    first = (
        once.groupBy(F.col("conv_id").alias("of"), F.col("content").alias("same"))
        .agg(F.min("at").alias("first"), F.count("*").alias("turns"))
        .where("turns > 1")
    )
    fault = (
        F.when(F.col("end") == "", BLANK)
        .when(F.col("at") > F.col("first"), DUPLICATE)
        .when(~F.col("end").isin(".", "!", "?"), TRUNCATED)
        .otherwise("")
    )
    joined = once.join(first, F.expr("conv_id <=> of AND content = same"), "left")
    return joined.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


def repair(rows: DataFrame, options: RepairOptions = RepairOptions()) -> DataFrame:
    """The cheapest edits that give each conversation of ``rows`` (conv_id, turn, role, text)
    the role initials ``(s?(ua)+)?``: conv_id, place (from 0), edit (Keep, Rerole, Delete,
    Insert by initial), n, turn, old_role, role, text, fault and cost. A row stands for n equal
    edits of the places from its own on. Without the deleted ones, ``role`` and ``text`` in order
    of ``place`` are the repaired conversation.

    Rows of one turn are in order of role and text; null turns come first, a null conv_id is
    a conversation of its own. Null roles and texts are one space, an empty role leads
    nowhere. Equal rows are one row with their number until they are edited. Texts of any length
    stay whole. An empty table gives no edits. Other columns are left behind.
    """
    faulty = with_faults(rows)
    id_type = faulty.schema["conv_id"].dataType
    id_name, id_arrow = id_type.simpleString(), _arrow(id_type)
    schema = pa.schema([("conv_id", id_arrow), ("choices", pa.int32()), *_EDIT_FIELDS])

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(schema)
        held, chars, costs, giant, at, begun = [], 0, _END, False, None, False

        def pending(row):
            cells = (at, row.choices, None, None, row.n, row.turn, row.role, row.role, row.text)
            return out.add((*cells, row.fault, None), len(row.text))

        def ended():
            for edit in _edited(reversed(held)):
                yield from out.add((at, None, *edit), len(edit[6]))

        for conv, turn, role, text, n, fault in _values(batches):
            if not begun or conv != at:
                yield from ended()
                held, chars, costs, giant, at, begun = [], 0, _END, False, conv, True
            row = _Row(turn, role, text, n, fault)
            costs, _, row.choices = step(costs, role[:1], fault)
            if giant:
                yield from pending(row)
                continue
            held.append(row)
            chars += len(text)
            if len(held) > options.held_rows or chars > options.held_chars:
                giant = True
                for row in held:
                    yield from pending(row)
                held = []
        yield from ended()
        yield out.batch()

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(pa.schema([f for f in schema if f.name != "choices"]))
        values, after = _values(batches), []

        def conversation(first):
            yield _Row(*first[1:])
            for value in values:
                if value[0] != first[0]:
                    after.append(value)
                    return
                yield _Row(*value[1:])

        after.extend(value for value in [next(values, None)] if value)
        while after:
            first = after.pop()
            for edit in _edited(conversation(first)):
                yield from out.add((first[0], *edit), len(edit[6]))
        yield out.batch()

    streamed = faulty.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc()
    )
    edits = f"conv_id {id_name}, {_EDIT_TYPES}"
    found = stored(
        streamed.mapInArrow(backward, f"conv_id {id_name}, choices int, {_EDIT_TYPES}"),
        "conversation-edits",
    )
    left = (
        found.where("choices IS NOT NULL")
        .select("conv_id", "turn", "role", "text", "n", "fault", "choices")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    )
    done = found.where("choices IS NULL").drop("choices")
    return done.unionByName(left.mapInArrow(forward, edits))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


#: What :func:`summary` says of a conversation without rows.
NOTHING = {
    **dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], 0),
    "audit": "",
    "repaired_sha256": hashlib.sha256(b"").hexdigest(),
}


class _Summary:
    """What a stream of edits of one conversation adds up to."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0)
        self.least = self.most = self.before = None
        self.turns = self.illegal = self.cost = 0
        self.audit, self.digest, self.empty = [], hashlib.sha256(), True

    def add(self, edit, n, turn, old_role, role, text, fault, cost) -> None:
        self.audit.append(edit * n)
        self.cost += cost
        if edit != "D":
            self.digest.update(f"{'' if self.empty else '\n'}{role}:{text}".encode())
            self.empty = False
        if edit == "I":
            return
        if fault:
            self.counts[fault] += n
        initial = old_role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.illegal += n - 1
        self.before = initial
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most = turn
            self.turns += 1

    def row(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        faults = tuple(self.counts.values())
        end = "".join(self.audit), self.digest.hexdigest()
        return (gaps, *faults, self.illegal, self.cost, *end)


def summary(edits: DataFrame) -> DataFrame:
    """A row for each conversation of ``edits`` (of :func:`repair`): conv_id, gaps in its
    turns, rows by fault, neighbours whose roles were illegal, cost, the initials of the
    edits, and the digest of the repaired rows, streamed in order of place.
    """
    id_type = edits.schema["conv_id"].dataType
    fields = [
        StructField(name, StringType() if isinstance(v, str) else LongType())
        for name, v in NOTHING.items()
    ]
    schema = StructType([StructField("conv_id", id_type), *fields])
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, total = _Writer(arrow), None, None
        for conv, _, *edit in _values(batches):
            if total is None or conv != at:
                if total is not None:
                    yield from out.add((at, *total.row()), sum(map(len, total.audit)))
                at, total = conv, _Summary()
            total.add(*edit)
        if total is not None:
            yield from out.add((at, *total.row()), 0)
        yield out.batch()

    columns = [name for name, _ in _EDIT_FIELDS]
    streamed = edits.select("conv_id", *columns).repartition("conv_id")
    return streamed.sortWithinPartitions("conv_id", "place").mapInArrow(run, schema)


def repaired_conversations(
    rows: DataFrame, ids: DataFrame | None = None, options: RepairOptions = RepairOptions()
) -> DataFrame:
    """:func:`summary` of the repair of ``rows`` for each conv_id of ``ids`` (of ``rows`` if not
    given); one without rows has zeros, no edits and the digest of nothing.
    """
    found = summary(repair(rows, options)).withColumnRenamed("conv_id", "of")
    every = (rows if ids is None else ids).select("conv_id").distinct()
    out = every.join(found, F.expr("conv_id <=> of"), "left")
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(v).cast(found.schema[c].dataType)).alias(c) for c, v in NOTHING.items()]
    )


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults, by ``crc32(conv_id:turn) % 20``: 0 drops
    the row, 1 empties its text, 2 removes the ends of its sentences, 3 repeats it (as n = 2),
    4 makes the user say it. Nulls are one space first; turns stay null.
    """

    def given(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat_ws(":", given("conv_id"), given("turn")).cast("binary")) % 20
    text = (
        F.when(fate == 1, "")
        .when(fate == 2, F.regexp_replace(given("text"), "[.!?]", ""))
        .otherwise(given("text"))
    )
    return rows.where(fate != 0).select(
        "conv_id",
        "turn",
        F.when(fate == 4, USER).otherwise(given("role")).alias("role"),
        text.alias("text"),
        F.when(fate == 3, 2).otherwise(1).cast("long").alias("n"),
    )
