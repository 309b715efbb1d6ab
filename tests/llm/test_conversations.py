"""Repair of conversations, next to brute force over all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest
from pyspark.sql import types as T

from usageweave.llm import conversations
from usageweave.llm.conversations import RepairOptions

SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        # Names that the operator uses itself.
        T.StructField("fault", T.StringType()),
        T.StructField("place", T.LongType()),
    ]
)
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        given = [" " if x is None else x for x in (conv, turn, role, text)]
        fate = zlib.crc32(f"{given[0]}:{given[1]}".encode()) % 20
        if fate == 0:
            continue
        role, text = given[2:]
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out += [(conv, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def ordered(rows):
    """Rows by conversation, by turn with nulls first, then by role and text."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return by


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.strip(SPACE)[-1:]
        if not end:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if end in ".!?" else "truncated")
        seen.add((role, text))
    return out


GOOD = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, repaired rows): the least of all ways through the rows, kept by the
    initials that stand so far, so that the order of roles is only tested at the end.
    """
    def inserted(ways):
        out = list(ways)
        for cost, audit, kept in ways:
            for n in (1, 2, 3):
                for roles in product(("user", "assistant"), repeat=n):
                    more = tuple((r, "") for r in roles)
                    out.append((cost + 5 * n, audit + "I" * n, kept + more))
        return out

    def pruned(ways):
        # What may follow depends on the last initial and on how it began only.
        best = {}
        for cost, audit, kept in ways:
            initials = "".join(r[:1] or "-" for r, _ in kept)
            if not re.fullmatch("s?(ua)*u?", initials):
                continue
            key = initials[-1:]
            if key not in best or (cost, audit) < best[key][:2]:
                best[key] = (cost, audit, kept)
        return list(best.values())

    ways = [(0, "", ())]
    for (_, role, text), fault in zip(rows, faults(rows)):
        ways = inserted(ways)
        after = []
        for cost, audit, kept in ways:
            after.append((cost + 2, audit + "D", kept))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault else 0
            after.append((cost + extra, audit + "K", (*kept, (role, text))))
            for new in ("user", "assistant"):
                after.append((cost + extra + 1, audit + "R", (*kept, (new, text))))
        ways = pruned(after)
    ended = [
        w for w in inserted(ways) if GOOD.fullmatch("".join(r[:1] or "-" for r, _ in w[2]))
    ]
    return min(ended, key=lambda w: (w[0], w[1]))


def brute(rows, ids):
    by = ordered(rows)
    out = {}
    for conv in ids:
        own = by.get(conv, [])
        found = faults(own)
        turns = {t for t, _, _ in own if t is not None}
        roles = [r[:1] for _, r, _ in own]
        cost, audit, kept = cheapest(own)
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *[found.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])),
            cost,
            audit,
            hashlib.sha256(text.encode()).hexdigest(),
        )
    return out


def some_rows(seed, n_conversations=60, turns=8):
    rnd = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "Use"]
    texts = ["Yes.", "No!", "no end", " \n", "", None, "Why?  ", "été.\t", "Yes."]
    rows = []
    for conv in range(n_conversations):
        for turn in range(rnd.randrange(1, turns)):
            if rnd.random() < 0.7:
                role = ["user", "assistant"][turn % 2]
            else:
                role = rnd.choice(roles)
            text = rnd.choice(texts) if rnd.random() < 0.6 else f"t{turn}."
            at = None if rnd.random() < 0.1 else turn * rnd.choice([1, 1, 2]) - 1
            rows.append((None if conv == 7 else conv, at, role, text))
            if rnd.random() < 0.1:
                rows.append(rows[-1])
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA).repartition(3)


def collected(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("options", [RepairOptions(), RepairOptions(held_rows=3)])
def test_repairs_equal_brute_force(spark, options):
    rows = some_rows(1)
    ids = {r[0] for r in rows}
    got = conversations.repaired_conversations(frame(spark, rows), options=options)
    assert got.columns[:2] == ["conv_id", "gaps"] and got.columns[-1] == "repaired_sha256"
    assert collected(got) == brute(rows, ids)


def test_damaged_conversations_equal_brute_force(spark):
    rows = some_rows(2, 150, 5)
    df = frame(spark, rows)
    got = conversations.repaired_conversations(conversations.damaged(df), df)
    assert collected(got) == brute(damage(rows), {r[0] for r in rows})


def test_query_equals_brute_force(spark):
    from __spark_entry__ import queries

    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    got = queries()["op11_conversation_repair"](spark, folder)
    assert collected(got) == brute(damage(rows), {r[0] for r in rows})


def test_edits_give_the_repaired_rows(spark):
    rows = [
        (1, 0, "system", "Be kind."),
        (1, 1, "user", "cut off"),
        (1, 2, "user", "Hello."),
        (1, 4, "assistant", "Hi."),
        (1, 4, "assistant", "Hi."),
        (2, 0, "assistant", "Well."),
    ]
    edits = conversations.repair(frame(spark, rows)).orderBy("conv_id", "place").collect()
    assert [(r.place, r.edit, r.old_role, r.role, r.fault, r.cost) for r in edits] == [
        (0, "K", "system", "system", "", 0),
        (1, "D", "user", "user", "truncated", 2),
        (2, "K", "user", "user", "", 0),
        (3, "K", "assistant", "assistant", "", 0),
        (4, "D", "assistant", "assistant", "duplicate", 2),
        (0, "D", "assistant", "assistant", "", 2),
    ]


def test_giant_conversation_in_two_streams(spark):
    rnd = random.Random(3)
    rows = [
        (1, i, rnd.choice(["user", "assistant", "assistant", "system"]), f"{i % 250}{rnd.choice('.!x')}")
        for i in range(600)
    ]
    rows += [(1, 3, "user", "again and again.")] * 300 + some_rows(4, 20)
    df = frame(spark, rows)
    held = collected(conversations.repaired_conversations(df))
    streamed = collected(
        conversations.repaired_conversations(df, options=RepairOptions(held_rows=100))
    )
    assert held == streamed == brute(rows, {r[0] for r in rows})


def test_very_long_texts_stay_whole(spark):
    rows = [(1, 0, "user", "w " * 2_000_000 + "?"), (1, 1, "assistant", "a" * 3_000_000 + ".")]
    got = collected(
        conversations.repaired_conversations(frame(spark, rows), options=RepairOptions(held_chars=10))
    )
    assert got == brute(rows, {1}) and got[1][5:7] == (0, "KK")


def test_no_conversations(spark):
    assert conversations.repaired_conversations(frame(spark, [])).count() == 0
    assert conversations.repair(frame(spark, [])).count() == 0


def test_conversation_without_rows_left(spark):
    rows = [(c, t, "user", "Hi.") for c in range(40) for t in range(1)]
    gone = {c for c, t, *_ in rows if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0}
    df = frame(spark, rows)
    got = collected(conversations.repaired_conversations(conversations.damaged(df), df))
    assert gone and set(got) == set(range(40))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert all(got[c] == nothing for c in gone)
