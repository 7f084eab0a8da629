"""Sessions merged part by part against one run over everything."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from aislewise.operators.incremental import SessionStore
from aislewise.operators.sessions import session_counts, session_summary

BASE = dt.datetime(2024, 5, 1)
SCHEMA = "who string, where string, timestamp timestamp_ntz"


def part(seed, n, first, last, people="abcdef"):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        at = BASE + dt.timedelta(minutes=rng.randrange(first * 60, last * 60), seconds=rng.choice([0, 0, 59]), microseconds=rng.choice([0, 999999]))
        rows.append((rng.choice([*people, None]), rng.choice(["x", "y", None]), rng.choice([at, at, at, at, None])))
    return rows


@pytest.mark.parametrize("gap", [60, 20])
def test_day_by_day_equals_the_full_run(spark, tmp_path, gap):
    """Parts in any order: later days, days before all others, rows between that join two sessions."""
    keys = ["who", "where"]
    store, seen = SessionStore(spark, str(tmp_path / "s"), keys, "timestamp", gap), []
    parts = [part(1, 80, 24, 48), part(2, 60, 48, 72), part(3, 30, 0, 24), part(4, 40, 20, 60, "ab"), [("new", "x", BASE), ("new", "x", BASE + dt.timedelta(minutes=2 * gap))], [("new", "x", BASE + dt.timedelta(minutes=gap))], []]
    for rows in parts:
        seen += rows
        made_again = store.add(spark.createDataFrame(rows, SCHEMA))
        assert made_again == len({r[:2] for r in rows})
        want = session_summary(spark.createDataFrame(seen, SCHEMA), keys, "timestamp", gap)
        got = store.sessions()
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert store.sessions().where("who = 'new'").count() == 1  # two sessions became one
    want = session_counts(spark.createDataFrame(seen, SCHEMA), keys, "timestamp", gap)
    assert store.counts().exceptAll(want).count() == 0 and store.counts().count() == want.count()


def test_other_keys_are_not_made_again(spark, tmp_path, monkeypatch):
    """A part of one key recomputes that key only, and a failed merge leaves the old sessions."""
    from aislewise.operators import incremental as I

    store = SessionStore(spark, str(tmp_path / "s"), ["who"])
    store.add(spark.createDataFrame(part(5, 200, 0, 48), SCHEMA))
    before = store.sessions().collect()
    plain, made = I.sessions_of_buckets, []
    monkeypatch.setattr(I, "sessions_of_buckets", lambda b, *a: made.append({r["who"] for r in b.collect()}) or plain(b, *a))
    store.add(spark.createDataFrame([("a", None, BASE + dt.timedelta(hours=100))], SCHEMA))
    assert made == [{"a"}] and store.sessions().count() == len(before) + 1

    def fails(*a):
        return plain(*a).withColumn("n_rows", F.expr("raise_error('lost')").cast("long"))

    monkeypatch.setattr(I, "sessions_of_buckets", fails)
    now = sorted(map(str, store.sessions().collect()))
    with pytest.raises(Exception, match="lost"):
        store.add(spark.createDataFrame([("b", None, BASE)], SCHEMA))
    assert sorted(map(str, store.sessions().collect())) == now
