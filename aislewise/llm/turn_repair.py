"""Repair of conversation structure by the cheapest edits, with square-root checkpoints.

The rows of a conversation in order of turn are to give role initials of the form ``(s?(ua)+)?``: an
optional system turn, then user and assistant in turn, or nothing at all. Edits and their costs:
``K`` keep 0, ``R`` set the role to user or assistant 1, ``D`` delete 2, ``I`` insert an empty user
or assistant turn 5. Rows with the fault ``blank`` (no character but white space) or ``duplicate``
(role and text stood earlier in the conversation) must be deleted; a row with the fault ``truncated``
(its last character but white space is none of ``.!?``) costs 5 more unless deleted. A row's first
fault counts. The ``audit`` of a conversation is the string of its cheapest edits, of several the
ASCII-least.

Method. Four states say what may follow (start, after s, after u, after a); a vector holds what the
rest of the conversation costs from each. The vectors are computed from the end, but only every
``sqrt(n)``-th is stored. Walking forward, each block's vectors are computed again from its checkpoint,
and the least letter among the tight edits is taken; a letter and a state determine the next state, so
this gives the least string.

How Spark carries it: rows become a byte each (role and faults) with a digest of role and text; equal
rows of one turn are counted before any shuffle, and a digest's first turn tells duplicates apart. Runs
are dealt by conversation and stream through a task sorted by turn, which holds one byte per row and the
stored vectors of one conversation, no texts. The texts are shuffled once, by conversation, after the audit of
their conversation, and stream past it. A conversation of a third of all rows is thus one task's
stream twice (its audit is one string and its digest is sequential), with external sorts, a byte a row in memory.

Defined cases: null roles and texts are one space, so a row with a null text is blank; null turns come
first, and rows of one turn are ordered by the digest of role and text; repeated rows are duplicates; null ids form one
conversation; roles are judged by their first character, others than s, u, a cannot be kept; empty and
very long texts are rows like others; ids without rows have zeros and an empty audit; empty input
gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.llm.common import arrow_schema, written

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A row's byte: the class of its role, and its faults.
OTHER, SYSTEM, USER, ASSISTANT = range(4)
BLANK, CUT, TWICE = 4, 8, 16
_CLASSES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: States are the class of the last role kept, OTHER at the start. What a kept role leads to, and the
#: role that an inserted or changed turn gets.
_KEEP = {(OTHER, SYSTEM), (OTHER, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
_NEXT = (USER, USER, ASSISTANT, USER)
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
Vector = tuple[int, int, int, int]


def _closed(v: list[int]) -> Vector:
    """Costs with any number of insertions before."""
    user, assistant = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return (min(v[OTHER], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant)


_FAR = 1 << 60
END: Vector = _closed([0, _FAR, _FAR, 0])


def _edits(code: int, state: int) -> list[tuple[str, int, int]]:
    """The edits of a row in ASCII order: letter, cost, next state."""
    out = [("D", DELETE, state)]
    if not code & (BLANK | TWICE):
        more = TRUNCATED if code & CUT else 0
        if (state, code & 3) in _KEEP:
            out.append(("K", more, code & 3))
        out.append(("R", REROLE + more, _NEXT[state]))
    return out


@lru_cache(maxsize=1 << 16)
def back(code: int, after: Vector) -> tuple[int, Vector]:
    """The vector before a row from the one after it: its least entry, and all entries less that."""
    v = _closed([min(cost + after[to] for _, cost, to in _edits(code, state)) for state in range(4)])
    return min(v), tuple(x - min(v) for x in v)


@lru_cache(maxsize=1 << 16)
def walk(code: int, after: Vector, state: int) -> tuple[str, int]:
    """The letters at a row, insertions before it included, and the state after it."""
    least, rest = back(code, after)
    letters = ""
    while True:
        here = least + rest[state]
        tight = {letter: to for letter, cost, to in _edits(code, state) if cost + after[to] == here}
        if INSERT + least + rest[_NEXT[state]] == here and "D" not in tight:
            letters, state = letters + "I", _NEXT[state]
            continue
        letter = min(tight)
        return letters + letter, tight[letter]


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a conversation of rows ``codes``."""
    n = len(codes)
    step = isqrt(max(n - 1, 0)) + 1
    stored, vector, cost = {}, END, 0
    for i in range(n - 1, -1, -1):
        if i == n - 1 or (i + 1) % step == 0:
            stored[i // step] = vector  # the vector after row i, the last of its block
        least, vector = back(codes[i], vector)
        cost += least
    cost += vector[OTHER]
    letters, state = [], OTHER
    for block in range(-(-n // step)):
        rows = codes[block * step : (block + 1) * step]
        after = [stored.pop(block)]
        for code in rows[:0:-1]:
            after.append(back(code, after[-1])[1])
        for code, vector in zip(rows, reversed(after), strict=True):
            got, state = walk(code, vector, state)
            letters.append(got)
        letters = ["".join(letters)]
    while END[state]:
        letters.append("I")
        state = _NEXT[state]
    return cost, "".join(letters)


class _Seen:
    """What is counted of one conversation as its runs stream by."""

    def __init__(self, key):
        self.key, self.codes, self.turns, self.low, self.high = key, bytearray(), 0, None, None

    def add(self, turn, code: int, n: int, first: bool) -> None:
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        if first:
            self.codes.append(code)
        self.codes.extend(bytes([code if code & BLANK else code | TWICE]) * (n - bool(first)))

    def row(self) -> tuple:
        codes = bytes(c & ~CUT if c & (BLANK | TWICE) else c for c in self.codes)
        roles = bytes(c & 3 for c in codes)
        illegal = max(0, len(codes) - 1) - sum(roles.count(bytes(pair)) for pair in _LEGAL)
        cost, audit = cheapest(codes)
        count = lambda fault: sum(codes.count(bytes([c])) for c in range(32) if c & fault)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.key, gaps, count(BLANK), count(TWICE), count(CUT), illegal, cost, audit


_FOUND = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _audits(runs: DataFrame) -> DataFrame:
    """A row per conversation from ``id``, ``turn``, ``code``, ``n``, ``first`` of its runs."""
    schema = f"id {runs.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in _FOUND) + ", audit string"
    arrow = arrow_schema(runs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, out = None, []
        for batch in batches:
            for key, turn, code, n, first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if seen is None or seen.key != key:
                    if seen is not None:
                        out.append(seen.row())
                    seen = _Seen(key)
                if n:
                    seen.add(turn, code, n, first)
                if len(out) >= 256:
                    yield batch_of(out)
                    out = []
        if seen is not None:
            yield batch_of([*out, seen.row()])

    def batch_of(rows):
        return pa.RecordBatch.from_pydict(dict(zip(arrow.names, map(list, zip(*rows, strict=True)), strict=True)), schema=arrow)

    return runs.repartition("id").sortWithinPartitions("id", "turn", "look").select("id", "turn", "code", "n", "first").mapInArrow(run, schema)


def _rows(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    one = lambda c: F.coalesce(df[c], F.lit(" "))
    rows = df.select(df[id_col].alias("id"), df[turn_col].alias("turn"), one(role_col).alias("role"), one(text_col).alias("text"))
    look = F.unhex(F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256), 1, 32))
    return rows.withColumn("look", look)


def _code(role: Column, text: Column) -> Column:
    end = F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1)
    faults = F.when(end == "", BLANK).when(end.isin(*".!?"), 0).otherwise(CUT)
    initial, kind = F.substring(role, 1, 1), F.lit(OTHER)
    for letter, number in _CLASSES.items():
        kind = F.when(initial == letter, number).otherwise(kind)
    return kind + faults


def audit_conversations(df: DataFrame, ids: DataFrame | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``id``, ``gaps`` in its turns, its faults, ``illegal`` neighbours of
    roles, ``cost`` and ``audit``. ``ids`` (one column) adds conversations that have no rows. Written once."""
    rows = _rows(df, id_col, turn_col, role_col, text_col)
    runs = rows.groupBy("id", "turn", "look").agg(F.count("*").alias("n"), F.min(_code(F.col("role"), F.col("text"))).alias("code"))
    runs = written(runs, "runs")
    # The least turn of a digest, nulls least, has its first row; it meets its run by the same key.
    firsts = runs.groupBy("id", "look").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("m"))
    marks = firsts.select("id", "m.turn", "look", F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("code"), F.lit(True).alias("first"))
    if ids is not None:
        none = ids.select(ids[ids.columns[0]].alias("id")).distinct()
        marks = marks.unionByName(none.withColumn("n", F.lit(0).cast("long")), allowMissingColumns=True)
    both = runs.withColumn("first", F.lit(False)).unionByName(marks)
    both = both.groupBy("id", "turn", "look").agg(F.sum("n").alias("n"), F.max("code").alias("code"), F.max("first").alias("first"))
    return written(_audits(both), "audits")


def repaired_turns(df: DataFrame, audits: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns of all conversations after their edits: ``id``, ``place`` (0, 1, ..), ``turn`` (null if
    inserted), ``role``, ``text`` and ``edit`` (K, R or I). A conversation's rows are in one partition, in order."""
    rows = _rows(df, id_col, turn_col, role_col, text_col)
    heads = audits.where("audit <> ''").select("id", "audit")
    stream = heads.withColumn("kind", F.lit(0)).unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    stream = stream.repartition("id").sortWithinPartitions("id", "kind", "turn", "look").select("id", "kind", "audit", "turn", "role", "text")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, place long, turn {rows.schema['turn'].dataType.simpleString()}, role string, text string, edit string"
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, last, at, state, place = None, "", 0, 0, OTHER, 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                out = []

                def put(turn, role, text, edit):
                    nonlocal place
                    out.append((key, place, turn, role, text, edit))
                    place += 1

                def inserted():
                    nonlocal at, state
                    while at < len(audit) and audit[at] == "I":
                        at, state = at + 1, _NEXT[state]
                        put(None, _NAMES[state], "", "I")

                for row in zip(*[c.to_pylist() for c in batch.slice(begin, 256).columns], strict=True):
                    if row[1] == 0:
                        key, audit, at, state, place = row[0], row[2], 0, OTHER, 0
                        last = len(audit.rstrip("I"))
                        continue
                    _, _, _, turn, role, text = row
                    inserted()
                    edit, at = audit[at], at + 1
                    if edit == "R":
                        state = _NEXT[state]
                        put(turn, _NAMES[state], text, edit)
                    elif edit == "K":
                        state = _CLASSES[role[0]]
                        put(turn, role, text, edit)
                    if at == last:  # what is inserted at the end
                        inserted()
                if out:
                    yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, map(list, zip(*out, strict=True)), strict=True)), schema=arrow)

    return stream.mapInArrow(run, schema)


def digests(turns: DataFrame) -> DataFrame:
    """``id`` and the SHA-256 of ``role:text`` of its turns, joined by line ends, of ``repaired_turns``'
    result (narrow: it relies on the order of the rows there)."""
    schema = f"id {turns.schema['id'].dataType.simpleString()}, repaired_sha256 string"
    arrow = arrow_schema(turns.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for begin in range(0, batch.num_rows, 256):
                for new, place, role, text in zip(*[c.to_pylist() for c in batch.slice(begin, 256).columns], strict=True):
                    if place == 0:
                        if digest is not None:
                            done.append((key, digest.hexdigest()))
                        key, digest = new, hashlib.sha256()
                    digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_pydict({"id": [k for k, _ in done], "repaired_sha256": [d for _, d in done]}, schema=arrow)
        if digest is not None:
            yield pa.RecordBatch.from_pydict({"id": [key], "repaired_sha256": [digest.hexdigest()]}, schema=arrow)

    return turns.select("id", "place", "role", "text").mapInArrow(run, schema)


def damaged(df: DataFrame) -> DataFrame:
    """``conversations`` with faults put in, by ``crc32(conv_id:turn) % 20``: 0 drops a row, 1 empties its
    text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.expr("array_repeat(0, if(fate = 3, 2, 1))"))).drop("col")
