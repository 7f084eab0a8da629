"""Stored sketches: answers of any period from them alone, within the stated errors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from aislewise.operators import sketches as S
from aislewise.operators.entities import signal_accuracy_by_role
from aislewise.operators.sales import iqr_fence
from aislewise.session import materialize

DAY = "timestampadd(SECOND, cast(id * 7919 % 5184000 as int), timestamp_ntz'2024-01-06 00:00:00')"  # 60 days


@pytest.fixture(scope="module")
def many_pings(spark):
    """400,000 pings of 30,000 devices, one of them in a tenth of all rows."""
    device = "if(id % 10 = 0, 'hot', cast(id * 31 % 30000 as string))"
    area = "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 7 = 0 THEN 'DEPOT' ELSE concat('A', cast(floor(sqrt(id % 90000)) as string)) END"
    return spark.range(400_000).selectExpr(f"{device} AS device_id", f"{DAY} AS timestamp", f"{area} AS area", "if(id % 2 = 0, 'x', NULL) AS role", "1.0D AS accuracy_m")


def test_visitor_estimates_within_three_errors(many_pings):
    hourly = materialize(S.hourly_visitor_sketches(many_pings))
    got = S.visitor_estimates(hourly)
    grains = {"hour": F.date_trunc("hour", "timestamp"), "day": F.date_trunc("day", "timestamp"), "week": F.date_sub(F.to_date("timestamp"), F.dayofweek("timestamp") - 1)}
    exact = None
    for g, at in grains.items():
        part = many_pings.groupBy(F.lit(g).alias("grain"), at.cast("timestamp_ntz").alias("starts_at")).agg(F.countDistinct("device_id").alias("exact"))
        exact = part if exact is None else exact.unionByName(part)
    met = got.join(exact, ["grain", "starts_at"], "full").withColumn("off", F.abs(F.col("unique_visitors") - F.col("exact")) / F.col("exact"))
    rows = met.groupBy("grain").agg(F.count("off").alias("n"), F.count(F.lit(1)).alias("all"), F.max("off").alias("worst"), F.max("exact").alias("most")).collect()
    assert {r["grain"] for r in rows} == set(grains) and max(r["most"] for r in rows) > 20_000
    for r in rows:
        assert r["n"] == r["all"] and r["worst"] < 4 * S.hll_error()  # over a thousand groups


def test_sketches_of_two_halves_equal_those_of_the_whole(many_pings):
    """Rows appended later need nothing before them."""
    first, second = many_pings.where("timestamp < '2024-02-01 00:30:00'"), many_pings.where("timestamp >= '2024-02-01 00:30:00'")
    halves = S.hourly_visitor_sketches(first).unionByName(S.hourly_visitor_sketches(second))
    a, b = S.visitor_estimates(halves, ("day",)), S.visitor_estimates(S.hourly_visitor_sketches(many_pings), ("day",))
    off = a.join(b.withColumnRenamed("unique_visitors", "v"), ["grain", "starts_at"]).select(F.max(F.abs(F.col("unique_visitors") - F.col("v")) / F.col("v"))).first()[0]
    assert off < 4 * S.hll_error()


@pytest.mark.parametrize("k", [64, 800])
def test_fences_of_any_period(spark, k):
    total = "CASE WHEN id % 3 = 0 THEN 10.5D WHEN id % 1001 = 0 THEN NULL ELSE round(pow(1.0002D, id * 37 % 50000), 2) END"
    sales = spark.range(200_000).selectExpr(f"{DAY} AS timestamp", f"{total} AS total")
    daily = materialize(S.daily_total_sketches(sales, k))
    assert daily.count() == 60
    start = dt.date(2024, 1, 6)
    periods = spark.createDataFrame([(start + dt.timedelta(a), start + dt.timedelta(b)) for a, b in [(0, 59), (3, 3), (10, 30), (59, 80), (0, 1)]] + [(dt.date(2030, 1, 1), dt.date(2030, 2, 1))], "first_day date, last_day date")
    rows = S.period_fences(daily, periods).collect()
    assert len(rows) == 5
    for r in rows:
        part = sales.where(F.to_date("timestamp").between(r["first_day"], r["last_day"]) & F.col("total").isNotNull())
        n, a, b, c, d = part.agg(F.count("total"), F.count_if(F.col("total") < r["q1"]), F.count_if(F.col("total") <= r["q1"]), F.count_if(F.col("total") < r["q3"]), F.count_if(F.col("total") <= r["q3"])).first()
        error = 2 * S.kll_error(k) * n  # twice: ten quantiles
        assert r["n_tickets"] == n and a - error <= 0.25 * n <= b + error and c - error <= 0.75 * n <= d + error
        assert r["upper_fence"] == pytest.approx(r["q3"] + 1.5 * (r["q3"] - r["q1"]))
    small = sales.where("id IS NULL") if "id" in sales.columns else sales.limit(500)
    exact, got = iqr_fence(small).first(), S.period_fences(S.daily_total_sketches(small, 5000), periods.limit(1)).first()
    assert got["n_tickets"] == small.where("total IS NOT NULL").count() and abs(got["q1"] - exact["q1"]) <= 1 and got["q3"] >= got["q1"]


def test_top_areas(many_pings):
    """NULL is an item; where items were dropped the answer is proven only by a clear lead."""
    exact = {r["role"]: (r["total_signals"], r["primary_area"]) for r in signal_accuracy_by_role(many_pings).collect()}
    daily = materialize(S.daily_area_sketches(many_pings))
    got = S.top_areas(daily).collect()
    assert {r["role"]: (r["total_signals"], r["primary_area"]) for r in got} == exact and all(r["proven"] for r in got)
    assert exact["x"][1] is None
    even = many_pings.withColumn("area", F.expr("concat('A', cast(hash(device_id, timestamp) % 5000 as string))"))
    assert not any(r["proven"] for r in S.top_areas(S.daily_area_sketches(even)).collect())
    tied = many_pings.sparkSession.createDataFrame([("r", "B"), ("r", "A"), ("r", None), ("s", None)], "role string, area string").withColumn("timestamp", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    assert {r["role"]: (r["primary_area"], r["proven"]) for r in S.top_areas(S.daily_area_sketches(tied)).collect()} == {"r": ("A", True), "s": (None, True)}


def test_empty(spark, many_pings):
    none = many_pings.limit(0)
    assert S.visitor_estimates(S.hourly_visitor_sketches(none)).count() == 0 and S.top_areas(S.daily_area_sketches(none)).count() == 0
    sales = spark.createDataFrame([], "timestamp timestamp_ntz, total double")
    assert S.yearly_fence_check(sales).count() == 0
