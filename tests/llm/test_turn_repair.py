import hashlib
import heapq
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from aislewise.llm import turn_repair as T
from aislewise.llm.oracles import ORACLES
from aislewise.llm.registry import op12_turn_repair

GOOD = re.compile(r"(s?(ua)+)?")


def brute(codes):
    """Cost and audit by search over all edit strings in order of cost, then ASCII."""
    heap = [(0, "", 0, "")]
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(codes) and GOOD.fullmatch(roles):
            return cost, audit
        if audit.endswith("III"):
            continue
        for r in "ua":
            heapq.heappush(heap, (cost + 5, audit + "I", i, roles + r))
        if i < len(codes):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles))
            if not codes[i] & (T.BLANK | T.TWICE):
                more = 5 if codes[i] & T.CUT else 0
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + "-sua"[codes[i] & 3]))
                for r in "ua":
                    heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, roles + r))
    raise AssertionError


def test_cheapest_against_search():
    rng = random.Random(3)
    for _ in range(150):
        codes = bytes(rng.choice([0, 1, 1, 2, 2, 2, 3, 3, 3]) + rng.choice([0, 0, 0, 0, T.BLANK, T.CUT, T.TWICE]) for _ in range(rng.randrange(7)))
        assert T.cheapest(codes) == brute(codes), codes


def test_long_conversations_keep_their_parts():
    """What surely ends a conversation's part does not depend on checkpoints: repeating a part repeats its audit."""
    part = bytes([T.USER, T.ASSISTANT | T.BLANK, T.ASSISTANT, T.USER, T.ASSISTANT])
    cost, audit = T.cheapest(part * 50_000)
    assert (cost, audit) == (2 * 50_000, "KDKKK" * 50_000)
    assert T.cheapest(b"") == (0, "") and T.cheapest(bytes([T.SYSTEM])) == (2, "D") and T.cheapest(bytes([T.USER])) == (2, "D")


def tables(spark, tmp_path, rows):
    clash = "id n look code first kind audit place edit".split()
    df = spark.createDataFrame([(*r, *[7] * len(clash)) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` int" for c in clash))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    return con


def random_rows(n, seed):
    rng = random.Random(seed)
    for conv in range(n):
        for turn in range(rng.randrange(12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Hi.", "Yes!", "no end", " \n\t", "", None, "é.", f"unique {turn}.", "tail. \r\n", "x\x0b", "\x1c"])
            yield (conv if conv % 9 else None, rng.choice([turn, turn, turn, 2 * turn, 3, None]), role, text)


def test_query_against_sql(spark, tmp_path):
    con = tables(spark, tmp_path, list(random_rows(120, 5)) + [(500, 1, "user", "long " * 700_000), (500, 2, "assistant", "end.")])
    got = op12_turn_repair(spark, str(tmp_path))
    rel = con.execute(ORACLES["op12_turn_repair"])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, rel.fetchall()))


def test_empty_table(spark, tmp_path):
    tables(spark, tmp_path, [])
    assert op12_turn_repair(spark, str(tmp_path)).collect() == []


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "assistant", " "), (1, 2, "assistant", "Yes."), (1, 3, "bot", "Kept."), (1, 4, "assistant", "Done."), (2, 0, "assistant", "Alone."), (3, None, "user", "Q?"), (3, 5, "assistant", "A!"), (3, 5, "assistant", "A!"), (3, 6, "system", "S.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    audits = T.audit_conversations(df)
    found = {r["id"]: (r["audit"], r["cost"], r["duplicate"], r["gaps"], r["illegal"]) for r in audits.collect()}
    assert found == {1: ("KDKRK", 3, 0, 0, 3), 2: ("D", 2, 0, 0, 0), 3: ("KKDD", 4, 1, 0, 2)}
    turns = T.repaired_turns(df, audits)
    got = {}
    for r in turns.orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append((r["turn"], r["role"], r["text"], r["edit"]))
    assert got[1] == [(0, "user", "Hello.", "K"), (2, "assistant", "Yes.", "K"), (3, "user", "Kept.", "R"), (4, "assistant", "Done.", "K")]
    assert got[3] == [(None, "user", "Q?", "K"), (5, "assistant", "A!", "K")] and 2 not in got
    want = {k: hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text, _ in v).encode()).hexdigest() for k, v in got.items()}
    assert {r[0]: r[1] for r in T.digests(turns).collect()} == want


@pytest.mark.parametrize("first", [True, False])
def test_hot_conversation_of_repeated_rows(spark, first):
    """Half of all rows are one conversation, and most of those are one row repeated."""
    hot = spark.range(60_000).selectExpr("7L AS conv_id", "if(id < 50000, 10, id) AS turn", "if(id < 50000 OR id % 2 = 0, 'user', 'assistant') AS role", "if(id < 50000, 'same.', concat('t', id, '.')) AS text")
    cold = spark.range(30_000).selectExpr("id + 100 AS conv_id", "explode(array(1L, 2L)) AS turn").selectExpr("conv_id", "turn", "if(turn = 1, 'user', 'assistant') AS role", "'Fine.' AS text")
    rows = hot.unionByName(cold) if first else cold.unionByName(hot)
    audits = T.audit_conversations(rows)
    row = audits.where("id = 7").first()
    assert (row["duplicate"], row["cost"], len(row["audit"])) == (49_999, 2 * 49_999 + 2, 60_000)
    assert audits.where("audit = 'KK' AND cost = 0").count() == 30_000
    turns = T.repaired_turns(rows, audits).groupBy("id").agg(F.count("*").alias("n"), F.max("place").alias("last"))
    assert turns.where("id = 7").first()["n"] == 10_000 and turns.where("n = 2 AND last = 1").count() == 30_000
