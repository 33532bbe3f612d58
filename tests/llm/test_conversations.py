"""Repair of conversations: exhaustive search over the edits, the SQL form, odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from tessera.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")
PREFIX = re.compile(r"(s?(ua)*u?)?")  # what a sound sequence can begin with
WORD = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """(cost, audit, repaired) by trying every sequence of edits; rows are (role, text, fault)."""
    found = []
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]

    def go(i, cost, audit, out):
        if not PREFIX.fullmatch("".join(r[:1] for r, _ in out)) or any(not r for r, _ in out):
            return
        last = i == len(rows)
        for extra in inserts:
            more, spent, said = out + [(r, "") for r in extra], cost + 2 * len(extra), audit + "I" * len(extra)
            if last:
                if GRAMMAR.fullmatch("".join(r[:1] for r, _ in more)):
                    found.append((spent, said, more))
                continue
            role, text, fault = rows[i]
            go(i + 1, spent + 3, said + "D", more)
            if fault not in ("blank", "duplicate"):
                extra_cost = fault == "truncated"
                go(i + 1, spent + extra_cost, said + "K", more + [(role, text)])
                for r in ("user", "assistant"):
                    if r != role:
                        go(i + 1, spent + 2 + extra_cost, said + "R", more + [(r, text)])

    go(0, 0, "", [])
    return min(found, key=lambda f: f[:2])


def plain(rows):
    """The result rows of a table, from the contract's words."""
    out = []
    for conv_id in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv_id), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", r[3] or " ")):
            key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
            harm, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
            role = "user" if harm == 4 else role
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            after += [(turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in after:
            words = WORD.findall(text)
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in after if t is not None]
        cost, audit, repaired = cheapest([(r, t, f) for (_, r, t), f in zip(after, faults)])
        out.append((
            conv_id, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(after)), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest(),
        ))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    made = []
    for conv_id in range(300):
        for turn in range(draw.randrange(1, 6)):
            made.append((conv_id, draw.choice([turn, turn, turn, turn * 3, None, 2]), draw.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown"]), draw.choice(["Yes.", "No", " ", "", None, "Why?\n", "one. two", "é!", "same.", "same."])))
    return made + [(None, None, None, None), (None, 3, "user", "a."), (2**62, -(2**61), "user", "a."), (-1, 1, "user", "x."), (-1, 1, "user", "x.")]


def result(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_against_every_sequence_of_edits(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", pos string, fault int")
    assert result(C.repair(C.damaged(frame))) == plain(rows)


def test_sql_form_on_odd_rows(spark, rows):
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.sql(C.SQL["op13_conversations"]).fetchall()
    assert sorted(map(str, want)) == plain(rows)


def test_every_small_sequence_of_roles():
    letters = {"s": C.S, "u": C.U, "a": C.A, "x": C.OTHER}
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    faults = {"": C.SOUND, "truncated": C.TRUNCATED, "blank": C.BLANK}
    for n in range(5):
        for roles in itertools.product("suax", repeat=n):
            for fault in itertools.product(faults, repeat=n) if n < 4 else [("",) * n, ("truncated",) + ("",) * (n - 1), ("", "blank") + ("",) * (n - 2)]:
                cost, kept = C.plan_edits(bytes(letters[r] for r in roles), bytes(faults[f] for f in fault))
                want = cheapest([(names[r], str(i), f) for i, (r, f) in enumerate(zip(roles, fault))])
                audit, before, at = "", C.START, 0
                for row, role in [*kept, (n, C.END)]:
                    audit += "D" * (row - at) + "I" * len(C.INSERTS[before, role]) + ("" if role == C.END else "K" if letters[roles[row]] == role else "R")
                    before, at = role, row + 1
                assert (cost, audit) == want[:2], (roles, fault)


def test_a_long_conversation_in_many_batches(spark):
    from pyspark.sql import functions as F

    rows = spark.range(60_000).select(
        F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("text "), F.col("id").cast("string"), F.lit(".")).alias("text"), F.lit(False).alias("gone"),
    )
    (row,) = C.repair(rows).collect()
    want = "\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:text {i}." for i in range(60_000))
    assert (row["gaps"], row["cost"], row["audit"], row["repaired_sha256"]) == (0, 0, "K" * 60_000, hashlib.sha256(want.encode()).hexdigest())


def test_conversations_without_rows(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "a.")], SCHEMA)
    assert result(C.repair(C.damaged(frame))) == [str((gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()))]
    assert C.repair(C.damaged(frame.limit(0))).count() == 0
