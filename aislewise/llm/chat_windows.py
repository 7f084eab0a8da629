"""Chat formatting in budgeted windows.

The turns of a conversation, in order, are cut into windows of at most ``budget`` tokens by prefix
sums of the turns' tokens. A window holds the conversation's system turn, up to ``history`` turns of
the window before (as many as fit in half the budget beside the system turn), and new turns. Spans are
aligned to turns: a turn that does not fit in the budget beside the system turn stands alone with it in
a window marked ``over_budget``. Loss is on
the text of new assistant turns; repeated turns are masked, so each assistant text counts once.

Template: a turn is ``### <role>: <text></turn>`` and a line end. Control strings inside roles and
texts are escaped reversibly: a backslash doubles, then ``### `` becomes ``\\h## `` and ``</turn>``
becomes ``\\l/turn>`` (in a role also ``:`` becomes ``\\c``), so they mark turns only.

Rows are dealt by conversation and streamed in order of turn: a task holds one window at a time,
never a whole conversation, however many rows one has. Defined cases: a null text or role is empty;
equal turns are ordered by role, then text, and repeated rows are turns of their own; a null turn
comes first; rows with a null conversation id form one conversation; a system turn is repeated only
if it is the first turn and takes less than the budget; empty input gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.llm.common import arrow_schema
from aislewise.llm.token_counts import PieceCounter

_TURN = re.compile(r"### ((?:[^:\\]|\\.)*): (.*?)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PLAIN = {"\\": "\\", "h": "#", "l": "<", "c": ":"}


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("### ", "\\h## ").replace("</turn>", "\\l/turn>")
    return text.replace(":", "\\c") if role else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends in it."""
    head = f"### {escape(role, role=True)}: "
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def _cost(turn: tuple[str, str, int]) -> int:
    return max(1, turn[2])  # whatever the counter says, so that a window ends somewhere


def windows_of(turns: Iterator[tuple[str, str, int]], budget: int, history: int) -> Iterator[list[tuple[str, str, int, bool]]]:
    """Turns ``(role, text, tokens)`` of one conversation as windows of ``(role, text, tokens, new)``."""
    system: list[tuple[str, str, int]] = []  # the retained system turn
    fresh = False  # no window holds it yet
    tail: list[tuple[str, str, int]] = []  # last turns of the window before
    waiting: list[tuple[str, str, int]] = []
    held = 0

    def cut(last: bool) -> Iterator[list]:
        nonlocal tail, waiting, held, fresh
        fixed = sum(map(_cost, system))
        while waiting and (last or held + fixed > budget):
            past: list[tuple[str, str, int]] = []
            for t in reversed(tail):
                if len(past) == history or fixed + sum(map(_cost, past)) + _cost(t) > budget // 2:
                    break
                past.insert(0, t)
            sums = list(accumulate(map(_cost, waiting)))
            n = bisect_right(sums, budget - fixed - sum(map(_cost, past)))
            if not n:  # the next turn does not fit: without history, then alone
                past = []
                n = max(1, bisect_right(sums, budget - fixed))
            if n == len(waiting) and not last:
                return
            new, waiting = waiting[:n], waiting[n:]
            held = sum(map(_cost, waiting))
            yield [(*t, fresh) for t in system] + [(*t, False) for t in past] + [(*t, True) for t in new]
            fresh = False
            tail = (tail + new)[-history:] if history else []

    first = True
    for turn in turns:
        if first and turn[0] == "system" and _cost(turn) < budget:
            system, fresh = [turn], True
        else:
            waiting.append(turn)
            held += _cost(turn)
            yield from cut(False)
        first = False
    yield from cut(True)
    if fresh:  # a conversation of a system turn alone
        yield [(*system[0], True)]


def format_windows(df: DataFrame, make_counter: Callable[[], Callable[[list[str]], list[int]]], budget: int = 2048, history: int = 2, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per window: ``id``, ``window``, ``text``, ``n_tokens``, ``n_repeated`` (leading turns
    that earlier windows hold too), ``loss`` (pairs of begin and end in code points of ``text``) and
    ``over_budget``. ``make_counter`` makes a function from texts to numbers of tokens.

    A system turn at the head is repeated in every window if it takes less than the budget; one that
    fills the budget by itself is a turn like any other."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, window long, text string, n_tokens long, n_repeated long, loss array<struct<begin:long,end:long>>, over_budget boolean"
    arrow = arrow_schema(df.sparkSession, schema)
    empty = F.lit("")
    turns = df.select(df[id_col].alias("id"), df[turn_col].alias("turn"), F.coalesce(df[role_col], empty).alias("role"), F.coalesce(df[text_col], empty).alias("text"))
    dealt = turns.repartition(F.col("id")).sortWithinPartitions("id", "turn", "role", "text")

    def run(batches):
        count = make_counter()

        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    roles, texts = part.column(2).to_pylist(), part.column(3).to_pylist()
                    tokens = count([format_turn(r, t)[0] for r, t in zip(roles, texts, strict=True)])
                    yield from zip(part.column(0).to_pylist(), roles, texts, tokens, strict=True)

        out = []
        for key, turns_of in _groups(rows()):
            for number, window in enumerate(windows_of(turns_of, budget, history)):
                text, loss, at = [], [], 0
                for role, body, _, new in window:
                    formatted, begin, end = format_turn(role, body)
                    if new and role == "assistant":
                        loss.append({"begin": at + begin, "end": at + end})
                    text.append(formatted)
                    at += len(formatted)
                tokens = sum(t[2] for t in window)
                out.append({"id": key, "window": number, "text": "".join(text), "n_tokens": tokens, "n_repeated": sum(not t[3] for t in window), "loss": loss, "over_budget": tokens > budget})
                if len(out) == 64:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return dealt.mapInArrow(run, schema)


def _groups(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Runs of rows with the same first field, as (field, iterator of the rest of each row)."""
    from itertools import groupby

    for key, run in groupby(rows, key=lambda r: r[0]):
        yield key, (r[1:] for r in run)


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows hold, read from their text and loss spans alone, one row per conversation:
    ``id``, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``,
    ``n_windows``. The windows must stand as ``format_windows`` makes them: all of a conversation in
    one partition, in order. The digests are updated window by window."""
    schema = f"id {windows.schema['id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    arrow = arrow_schema(windows.sparkSession, schema)

    def run(batches):
        rows = ((r["id"], r["text"], r["n_repeated"], r["loss"]) for b in batches for at in range(0, b.num_rows, 64) for r in b.slice(at, 64).to_pylist())
        out = []
        for key, windows_in in _groups(rows):
            turns, loss, n, chars, size, count = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
            for text, repeated, spans in windows_in:
                count += 1
                size += len(text)
                for role, body in _TURN.findall(text)[repeated:]:
                    n += 1
                    turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                for span in spans:
                    body = unescape(text[span["begin"] : span["end"]])
                    chars += len(body)
                    loss.update(body.encode())
            out.append({"id": key, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size, "n_windows": count})
            if len(out) == 1024:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return windows.select("id", "text", "n_repeated", "loss").mapInArrow(run, schema)


def piece_counter(model_file: str) -> Callable[[], Callable[[list[str]], list[int]]]:
    """Token counts by a sentencepiece model, as ``make_counter``."""
    return lambda: PieceCounter(model_file).count_all
