"""Sessionize and exact percentiles against brute force on random data."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from aislewise.functions.quantiles import percentiles
from aislewise.functions.timeparts import sunday_week, sunday_week_start
from aislewise.functions.timeparts import whole_minutes
from aislewise.operators.sessions import session_counts, session_summary


def brute_sessions(rows, gap):
    """rows: list of (key, ts). Returns {(key, first_ts): size} using the lag rule."""
    by_key = {}
    for k, t in rows:
        by_key.setdefault(k, []).append(t)
    out = {}
    for k, ts in by_key.items():
        ts.sort()
        start, size, prev = None, 0, None
        for t in ts:
            minutes = None if prev is None else int((t - prev).total_seconds() // 60)
            if prev is None or minutes > gap:
                if start is not None:
                    out[(k, start)] = size
                start, size = t, 0
            size += 1
            prev = t
        out[(k, start)] = size
    return out


@pytest.mark.parametrize("seed,gap", [(1, 60), (2, 20), (3, 60), (4, 5), (5, 0), (6, 20)])
def test_sessions_match_brute_force(spark, seed, gap):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for k in ["a", "b", "c", None]:
        t = base + dt.timedelta(minutes=rnd.randint(0, 3000))
        for _ in range(rnd.randint(1, 80)):
            step = rnd.choice([0, 1, gap - 1, gap, gap + 1, 3 * gap, rnd.randint(0, 600)])
            t = t + dt.timedelta(minutes=step, seconds=rnd.choice([0, 0, 30, 59]), microseconds=rnd.choice([0, 999999]))
            rows.append((k, t))
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz")
    expected = brute_sessions(rows, gap)
    summary = session_summary(df, ["k"], "ts", gap).collect()
    assert {(r["k"], r["session_begin"]): r["n_rows"] for r in summary} == expected
    # Rows without a timestamp are visits of their own and change no other session.
    more = df.unionByName(spark.createDataFrame([("a", None)] * 3 + [("z", None)] + [(None, None)] * 2, df.schema))
    expected_counts = {"a": 3, "z": 1, None: 2}
    for k, _ in expected:
        expected_counts[k] = expected_counts.get(k, 0) + 1
    assert {r["k"]: r["n_sessions"] for r in session_counts(more, ["k"], "ts", gap).collect()} == expected_counts


def sessionize_naive(df, keys, ts="timestamp", gap_minutes=60):
    """Textbook lag + running-sum form, one window partition per key."""
    w = Window.partitionBy(*keys).orderBy(ts)
    prev = F.lag(F.col(ts)).over(w)
    flagged = df.withColumn("__new", (prev.isNull() | (whole_minutes(prev, F.col(ts)) > gap_minutes)).cast("int"))
    return flagged.withColumn("session_id", F.sum("__new").over(w)).withColumnRenamed("__new", "session_start")


def test_percentiles_match_brute_force(spark):
    rnd = random.Random(7)
    vals = [round(rnd.choice([rnd.uniform(0, 100), 50.0, 75.5]), 2) for _ in range(2000)] + [None] * 13
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    ps = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]
    names = [f"p{i}" for i in range(len(ps))]
    got = percentiles(df, "x", ps, names, pivots=16).first()
    assert got == percentiles(df, "x", ps, names, pivots=4, max_sorted=3).first()  # in many rounds
    xs = sorted(v for v in vals if v is not None)
    for p, n in zip(ps, names):
        rank = max(1, math.ceil(len(xs) * p))
        assert got[n] == xs[rank - 1], (p, got[n], xs[rank - 1])


def test_a_million_distinct_values_in_rounds(spark, monkeypatch):
    """However many distinct values there are, no task sorts more than ``max_sorted`` of them."""
    from aislewise.functions import quantiles as Q

    df = spark.range(1_000_000).selectExpr("cast(id * 7919 % 1000003 as double) / 8 AS x").unionByName(spark.range(300_000).selectExpr("-1.5D AS x"))
    counts = Q.value_counts(df, "x")
    sizes = []
    plain = Q._narrowed
    monkeypatch.setattr(Q, "_narrowed", lambda *a: sizes.append(plain(*a)) or sizes[-1])
    ps = [0.1, 0.25, 0.5, 0.99]
    got = Q.counted_percentiles(counts, ps, pivots=32, max_sorted=500)
    xs = sorted([i * 7919 % 1000003 / 8 for i in range(1_000_000)] + [-1.5] * 300_000)
    assert got == [xs[math.ceil(len(xs) * p) - 1] for p in ps]
    last = [a for a, b in zip(sizes, sizes[1:] + [None]) if b is None or b.rank != a.rank]
    assert len(last) == 4 and all(a.values <= 500 for a in last) and len(sizes) <= 4 * 4
    sizes.clear()
    assert Q.counted_percentiles(counts, ps[:1], max_sorted=10**7) == got[:1] and not sizes


def test_percentiles_of_odd_values(spark):
    inf = float("inf")
    vals = [float("nan"), inf, -inf, 1e300, -1e300, 5e-324, 0.0, -0.0, 0.1, 0.1]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for limit in (2, 100):
        got = percentiles(df, "x", [0.1, 0.2, 0.3, 0.4, 0.5, 0.8, 0.9], list("abcdefg"), pivots=3, max_sorted=limit).first()
        assert tuple(got) == (-inf, -1e300, 0.0, 0.0, 5e-324, 1e300, inf)


def test_percentiles_empty_and_approx(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert percentiles(df, "x", [0.5], ["m"]).first()["m"] is None
    df = spark.range(1, 1001).selectExpr("cast(id as double) x")
    assert percentiles(df, "x", [0.5], ["m"], exact=False).first()["m"] == 500.0


def test_sunday_week_against_strftime(spark):
    days = [dt.date(2015, 1, 1) + dt.timedelta(days=i) for i in range(0, 365 * 12, 3)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = df.select("d", sunday_week("d").alias("w"), sunday_week_start("d").alias("s")).collect()
    for r in got:
        assert r["w"] == int(r["d"].strftime("%U"))
        assert r["s"] == r["d"] - dt.timedelta(days=(r["d"].weekday() + 1) % 7)


def test_session_counts_match_summary(spark, tables):
    keys = ["customer_id", "d"]
    rows = tables.sales.withColumn("d", F.to_date("timestamp"))
    a = session_counts(rows, keys, "timestamp", 60)
    b = session_summary(rows, keys, "timestamp", 60).groupBy(*keys).agg(F.count("*").alias("n_sessions"))
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


@pytest.mark.parametrize("gap,area", [(60, None), (20, "CASH_REGISTERS")])
def test_session_summary_equals_textbook_lag_form(spark, tables, gap, area):
    """Rewrite equivalence on the fixture: two-level sessions == one window per device."""
    geo = tables.geo if area is None else tables.geo.where(F.col("area") == area)
    naive = (
        sessionize_naive(geo, ["device_id"], "timestamp", gap)
        .groupBy("device_id", "session_id")
        .agg(F.min("timestamp").alias("session_begin"), F.max("timestamp").alias("session_end"), F.count("*").alias("n_rows"))
        .drop("session_id")
    )
    ours = session_summary(geo, ["device_id"], "timestamp", gap)
    assert ours.count() == naive.count()
    assert ours.exceptAll(naive).count() == 0 and naive.exceptAll(ours).count() == 0
