import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from aislewise.llm import chat_windows as W

words = lambda: lambda texts: [len(t.split()) for t in texts]  # noqa: E731  tokens as words


@given(st.text(), st.text())
def test_escape_round_trip(role, text):
    turn, begin, end = W.format_turn(role, text)
    assert W.unescape(turn[begin:end]) == text
    assert [(W.unescape(r), W.unescape(t)) for r, t in W._TURN.findall(turn + W.format_turn("x", "</turn>\n### y: ")[0])] == [(role, text), ("x", "</turn>\n### y: ")]
    assert "### " not in turn[begin:end] and "</turn>" not in turn[begin:end]


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(30):
        roles = (["system"] if rng.random() < 0.6 else []) + [rng.choice(["user", "assistant", "tool"]) for _ in range(rng.randrange(12))]
        for t, role in enumerate(roles):
            n = rng.choice([0, 1, 5, 20, 60])
            rows.append((c, t, role, " ".join(rng.choice(["a", "b", "</turn>", "### user:", "\\h", "é"]) for _ in range(n))))
    return rows


def digest(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        turns = [(r or "", t or "") for _, r, t in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("budget,history", [(10_000, 2), (64, 2), (30, 1), (30, 0), (1, 3)])
def test_read_back_and_budgets(spark, budget, history):
    rows = conversations(budget)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, id string").repartition(5)
    windows = W.format_windows(df, words, budget, history)
    got = {r["id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in W.read_back(windows).collect()}
    assert got == digest(rows)
    seen = {}
    for r in sorted(windows.collect(), key=lambda r: (r["id"], r["window"])):
        turns = [(a, W.unescape(b)) for a, b in W._TURN.findall(r["text"])]
        assert r["n_tokens"] == sum(len(W.format_turn(a, t)[0].split()) for a, t in turns) == len(r["text"].split())
        new = turns[r["n_repeated"] :]
        assert new and len(r["loss"]) == sum(a == "assistant" for a, _ in new)
        assert r["over_budget"] == (r["n_tokens"] > budget)
        if r["over_budget"]:  # a single turn that does not fit beside the system turn
            assert len(new) == 1 or (len(new) == 2 and new[0][0] == "system")
        past = seen.setdefault(r["id"], [])
        repeated = turns[: r["n_repeated"]]
        if repeated and past[0][0] == "system" and repeated[0] == past[0]:
            repeated = repeated[1:]
        assert len(repeated) <= history and (not repeated or repeated == past[-len(repeated) :])
        past += new


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, window string"
    rows = [(1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (1, None, "assistant", "first", "x"), (None, 0, "user", "a", "x"), (None, 1, None, None, "x"), (2, 0, "assistant", "x" * 100_000, "x"), (3, 1, "assistant", "b", "x"), (3, 1, "assistant", "a", "x")]
    df = spark.createDataFrame(rows, schema)
    got = {r["id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in W.read_back(W.format_windows(df, words, 50)).collect()}
    assert got == digest([r[:4] for r in rows])
    assert W.read_back(W.format_windows(df.limit(0), words)).count() == 0


@pytest.mark.parametrize("size", [10, 25, 60, 97])
def test_long_system_turn_in_every_window(spark, size):
    system = " ".join(["s"] * size)
    rows = [(1, 0, "system", system)] + [(1, 1 + i, ["user", "assistant"][i % 2], " ".join(["w"] * (1 + i % 30))) for i in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = W.format_windows(df, words, 100).collect()
    assert len(windows) > 5
    for r in windows:
        turns = [(a, W.unescape(b)) for a, b in W._TURN.findall(r["text"])]
        assert turns[0] == ("system", system) and sum(a == "system" for a, _ in turns) == 1
        assert r["n_tokens"] <= 100 or (r["over_budget"] and len(turns) == 2)
        assert r["n_repeated"] == 0 or r["window"] > 0


def test_query(spark):
    from aislewise.llm.registry import QUERIES

    base = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{base}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    text = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", text), (-7, 1, "assistant", text)]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in QUERIES["op10_chat_windows"](spark, base).collect()}
    assert got == digest(rows) and got[-7][2] == 26


def test_many_short_turns_keep_to_the_budget(spark):
    """The template counts: turns of one word take three tokens here."""
    rows = [(1, i, ["user", "assistant"][i % 2], "w") for i in range(1000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in W.format_windows(df, words, 90).collect():
        assert len(r["text"].split()) == r["n_tokens"] <= 90 and not r["over_budget"]
