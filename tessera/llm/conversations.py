"""Repair of conversation structure by a dynamic program over the retained turns.

``repair`` takes the rows of conversations and finds, for each, the cheapest edits after
which the roles read ``(s?(ua)+)?`` by their initials: Keep a row (0), Rerole it to user or
assistant (2), Delete it (3; blank and duplicate rows must go), or Insert an empty turn of
user or assistant (2). A truncated row that stays costs 1 more.

The program goes over the turns from the last to the first. What it costs to go on behind
a retained turn is the price of the gap (the difference of two prefix sums of deletion
costs, and the inserts that the pair of roles before and behind the gap asks for) plus
the cost from the next retained turn on. For each role of that next turn a running
minimum holds the best one, so that a row is looked at a fixed number of times. Of equally
cheap edits those win whose initials are least in ASCII: the gap that deletes further
comes first, then the one with an insert, then Keep, then Rerole, and two different
choices always differ in one of these, so no strings of edits are compared.

Spark partitions by conversation and sorts; within a task the rows of a conversation pass
twice: first two bytes a row (role and fault), which give the plan, then the texts, which
run through the digest one by one. So a very long conversation takes memory only for its
own audit, which is one cell of the result. Its rows do pass through one task, in order,
because the digest of the repaired conversation does.

Edge cases: a null conv_id is a conversation of its own; null turns come first; a null role
or text is one space; rows of equal turn are taken by role, then text; roles whose initial
is none of s, u and a (the empty one as well) can't be kept; a conversation without rows
after the damage has zeros, an empty audit and the digest of nothing; a span of turns too
long for a long is given as the largest long; rows that repeat are duplicates; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WS, table

KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1
MAX_LONG = 2**63 - 1
#: role classes; a row of class OTHER can't be kept
OTHER, S, U, A = range(4)
ROLE = {S: "system", U: "user", A: "assistant"}
SOUND, TRUNCATED, DUPLICATE, BLANK = range(4)
#: roles of the inserts between two retained turns, by (role before, role behind);
#: START and END are the edges of the conversation
END, START = 4, 5
INSERTS = {
    (START, S): (), (START, U): (), (START, A): (U,), (START, END): (),
    (S, U): (), (S, A): (U,), (S, END): (U, A),
    (U, A): (), (U, U): (A,), (U, END): (A,),
    (A, U): (), (A, A): (U,), (A, END): (),
}
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def plan_edits(roles: bytes, faults: bytes) -> tuple[int, list[tuple[int, int]]]:
    """(cost, retained rows as (row, role)) of the cheapest, ASCII-least edits."""
    n = len(roles)
    behind = {S: None, U: None, A: None}  # role of the next retained turn -> (deletions before it + cost from it on, row)
    marks, onward = bytearray(n), bytearray(n)  # per row: roles for which it became the best next turn; the roles behind it

    def best_gap(before: int, first: int) -> tuple[int, int] | None:
        """(cost, next role) when the rows from ``first`` on follow a turn of role ``before``."""
        found = None
        for role in (S, U, A, END):
            between = INSERTS.get((before, role))
            if between is None:
                continue
            if role == END:
                value, row, order = DELETE_COST * n, n, 0
            elif behind[role] is None:
                continue
            else:
                value, row = behind[role]
                order = 0 if between else 1 if roles[row] == role else 2
            # deleting further, then inserting, then keeping has the smaller audit
            key = (value - DELETE_COST * first + INSERT_COST * len(between), -row, order, role)
            if found is None or key < found:
                found = key
        return found and (found[0], found[3])

    for row in range(n - 1, -1, -1):
        fault, own = faults[row], roles[row]
        if fault in (BLANK, DUPLICATE):
            continue
        better = []
        for role in (S, U, A):
            if role == S != own:
                continue
            cost, following = best_gap(role, row + 1)
            cost += (KEEP_COST if role == own else REROLE_COST) + (TRUNCATED_COST if fault == TRUNCATED else 0)
            onward[row] |= (following - S) << 2 * (role - S)
            value = DELETE_COST * row + cost
            if behind[role] is None or value < behind[role][0]:
                better.append((role, value))
        for role, value in better:
            behind[role] = (value, row)
            marks[row] |= 1 << role

    cost, role = best_gap(START, 0)
    retained, row = [], 0
    while role != END:
        while not marks[row] & 1 << role:
            row += 1
        retained.append((row, role))
        role = (onward[row] >> 2 * (role - S) & 3) + S
        row += 1
    return cost, retained


class _Conversation:
    """What is known of the conversation whose rows are passing."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.roles, self.faults, self.initials = bytearray(), bytearray(), "?"
        self.first = self.last = None
        self.distinct = self.illegal = 0
        self.plan = None
        self.sha, self.audit, self.any = hashlib.sha256(), bytearray(), False

    def note(self, turn, role: str, fault: int) -> None:
        """A row of the first pass."""
        initial = role[:1]
        if self.roles:
            self.illegal += self.initials + initial not in ("su", "ua", "au")
        self.initials = initial
        self.roles.append({"s": S, "u": U, "a": A}.get(initial, OTHER))
        self.faults.append(fault)
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn

    def _decide(self) -> None:
        self.cost, retained = plan_edits(self.roles, self.faults)
        self.plan, self.at, self.before = iter([*retained, (len(self.roles), END)]), 0, START
        self.next = next(self.plan)

    def _put(self, role: str, text: str) -> None:
        if self.any:
            self.sha.update(b"\n")
        self.any = True
        self.sha.update(role.encode() + b":")
        self.sha.update(text.encode())

    def _insert(self, role: int) -> None:
        for between in INSERTS[self.before, role]:
            self._put(ROLE[between], "")
            self.audit += b"I"
        self.before = role

    def read(self, role: str, text: str) -> None:
        """A row of the second pass."""
        if self.plan is None:
            self._decide()
        row, as_role = self.next
        if self.at < row:
            self.audit += b"D"
        else:
            self._insert(as_role)
            kept = self.roles[row] == as_role
            self._put(role if kept else ROLE[as_role], text)
            self.audit += b"K" if kept else b"R"
            self.next = next(self.plan)
        self.at += 1

    def result(self) -> tuple:
        if self.plan is None:
            self._decide()
        self._insert(END)
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.distinct, MAX_LONG)
        return (
            self.conv_id, gaps, self.faults.count(BLANK), self.faults.count(DUPLICATE), self.faults.count(TRUNCATED),
            self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest(),
        )


def _repair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in (c.split()[0] for c in RESULT.split(", "))])
    done, size, now = [], 0, None

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    for batch in batches:
        for conv_id, step, gone, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.result())
                    size += len(done[-1][-2]) + 200
                now = _Conversation(conv_id)
                if size > 1 << 22:
                    yield flush()
                    done, size = [], 0
            if gone:
                continue
            if step == 0:
                now.note(turn, role, fault)
            else:
                now.read(role, text)
    if now is not None:
        done.append(now.result())
        yield flush()


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the planted damage: conv_id, turn, role, text and ``gone`` (true: dropped)."""
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    harm = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn"))) % 20
    return (
        conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), harm.cast("int").alias("harm"))
        .select(
            F.col("conv_id").cast("long"), F.col("turn").cast("long"),
            F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("harm") <= 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
            (F.col("harm") == 0).alias("gone"),
            F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def repair(rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``rows`` (conv_id, turn, role, text; where ``gone``, a row counts only
    for its conv_id): counts of faults, the cheapest edits and the digest of the repaired conversation."""
    by_turn = Window.partitionBy("conv_id").orderBy("gone", F.asc_nulls_first("turn"), "role", "text")
    earlier = Window.partitionBy("conv_id", "gone", "role", "text").orderBy("pos")
    end = F.rtrim(F.col("text"), F.lit(WS))
    placed = rows.withColumn("pos", F.row_number().over(by_turn))
    judged = placed.withColumn(
        "fault",
        F.when(end == "", BLANK)
        .when(F.row_number().over(earlier) > 1, DUPLICATE)
        .when(~F.substring(end, -1, 1).isin(".", "!", "?"), TRUNCATED)
        .otherwise(SOUND),
    )
    twice = judged.withColumn("step", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("text", F.when(F.col("step") == 1, F.col("text")))
    ordered = twice.sortWithinPartitions("conv_id", "step", "pos")
    return ordered.select("conv_id", "step", "gone", "turn", "role", "text", "fault").mapInArrow(_repair_rows, RESULT)


def op13_conversations(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


QUERIES = {"op13_conversations": op13_conversations}

# The same edits as a walk from the first row to the last that compares whole audits: each
# conversation has at most four states (the role of the last retained turn).
SQL = {
    "op13_conversations": r"""
WITH RECURSIVE crc(i, c) AS (
  SELECT i, CAST(i AS BIGINT) FROM range(256) t(i)
), crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS v FROM crc)
), raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations
), hashed AS (
  SELECT raw.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda ch: ascii(ch)::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS harm
  FROM raw, crc_table
), rows_after AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, (VALUES (0), (1)) c(copy) WHERE harm <> 0 AND (copy = 0 OR harm = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM rows_after
), judged AS (
  SELECT conv_id, turn, role, text, pos, left(role, 1) AS ini,
    CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM placed
), faults AS (
  SELECT conv_id, max(pos) AS n, CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), moves(before, behind, audit, turns) AS (
  VALUES ('', 's', '', ''), ('', 'u', '', ''), ('', 'a', 'I', chr(10) || 'user:'), ('s', 'u', '', ''), ('s', 'a', 'I', chr(10) || 'user:'),
    ('u', 'a', '', ''), ('u', 'u', 'I', chr(10) || 'assistant:'), ('a', 'u', '', ''), ('a', 'a', 'I', chr(10) || 'user:')
), ends(before, audit, turns) AS (
  VALUES ('', '', ''), ('a', '', ''), ('u', 'I', chr(10) || 'assistant:'), ('s', 'II', chr(10) || 'user:' || chr(10) || 'assistant:')
), walk(conv_id, pos, state, cost, audit, turns) AS (
  SELECT conv_id, 0::BIGINT, '', 0::BIGINT, '', '' FROM faults
  UNION ALL
  SELECT conv_id, pos, state, cost, audit, turns FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS best FROM (
      SELECT w.conv_id, j.pos, w.state, w.cost + 3 AS cost, w.audit || 'D' AS audit, w.turns
      FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.pos = w.pos + 1
      UNION ALL
      SELECT w.conv_id, j.pos, m.behind, w.cost + 2 * length(m.audit) + CASE WHEN j.ini = m.behind THEN 0 ELSE 2 END + CASE WHEN j.fault = 'truncated' THEN 1 ELSE 0 END,
        w.audit || m.audit || CASE WHEN j.ini = m.behind THEN 'K' ELSE 'R' END,
        w.turns || m.turns || chr(10) || CASE WHEN j.ini = m.behind THEN j.role WHEN m.behind = 'u' THEN 'user' ELSE 'assistant' END || ':' || j.text
      FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.pos = w.pos + 1 JOIN moves m ON m.before = w.state
      WHERE j.fault NOT IN ('blank', 'duplicate') AND (m.behind <> 's' OR j.ini = 's')))
  WHERE best = 1
), finished AS (
  SELECT w.conv_id, w.cost + 2 * length(e.audit) AS cost, w.audit || e.audit AS audit, w.turns || e.turns AS turns,
    row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 2 * length(e.audit), w.audit || e.audit) AS best
  FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.pos JOIN ends e ON e.before = w.state
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(substr(coalesce(turns, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN (SELECT * FROM finished WHERE best = 1) d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
""",
}
