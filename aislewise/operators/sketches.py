"""Stored sketches: small mergeable summaries per hour or day, from which any period is answered without the facts.

- ``hourly_visitor_sketches``: distinct devices per hour as HyperLogLog sketches, of a stream or a table;
  ``visitor_estimates`` rolls them up to days and weeks. A stream's state is one sketch an hour, however many
  devices there are.
- ``daily_total_sketches``: the distribution of ticket totals per day as KLL sketches; ``period_fences`` gives
  quartiles and the outlier fence of any period.
- ``daily_area_sketches``: the most frequent areas per day and role as frequent-items sketches;
  ``top_areas`` gives each role's most frequent area over any period and says whether it is proven.

The errors are those of the public sketches, as functions of their size: ``hll_error`` (relative standard
error), ``kll_error`` (rank error, with 99 % confidence) and ``items_error`` (share of all rows, certain).
A new day is added by appending its rows to the stored table; nothing before it is read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.functions.timeparts import sunday_week_start

#: log2 of a HyperLogLog sketch's buckets: 4 KB, relative standard error 1.6 %.
LG_K = 12
#: Size of a KLL sketch: rank error 0.4 %.
KLL_K = 800
#: Items that a frequent-items sketch keeps.
ITEMS = 256


def hll_error(lg_k: int = LG_K) -> float:
    """Relative standard error of a distinct count from merged sketches."""
    return 1.04 / 2 ** (lg_k / 2)


def kll_error(k: int = KLL_K) -> float:
    """Error of a quantile's rank, as a share of all rows, that 99 of 100 quantiles keep to."""
    return 2.296 / k**0.9723


def items_error(items: int = ITEMS) -> float:
    """Largest error of an item's number, as a share of all rows."""
    return 3.5 / items


def hourly_visitor_sketches(geo: DataFrame, lg_k: int = LG_K, time: str = "timestamp") -> DataFrame:
    """``hour_start`` and the sketch ``visitors`` of its devices. Of a stream, ``time`` is a column with a
    watermark, and an hour comes when the watermark has passed it."""
    hours = geo.groupBy(F.window(time, "1 hour").alias("w")).agg(F.hll_sketch_agg("device_id", F.lit(lg_k)).alias("visitors"))
    return hours.select(F.col("w.start").alias("hour_start"), "visitors")


def _grain(grain: str) -> Column:
    day = F.to_date("hour_start")
    return {"hour": F.col("hour_start").cast("timestamp_ntz"), "day": day.cast("timestamp_ntz"), "week": sunday_week_start("hour_start").cast("timestamp_ntz")}[grain]


def visitor_estimates(hourly: DataFrame, grains: tuple[str, ...] = ("hour", "day", "week")) -> DataFrame:
    """``grain``, ``starts_at`` and estimated ``unique_visitors`` from hourly sketches: hours, dates and
    weeks from Sunday on, merged from the sketches alone."""
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), _grain(g).alias("starts_at")) for g in grains]))
    rows = hourly.select("visitors", each.alias("g")).select("g.*", "visitors")
    return rows.groupBy("grain", "starts_at").agg(F.hll_sketch_estimate(F.hll_union_agg("visitors")).alias("unique_visitors"))


def daily_total_sketches(sales: DataFrame, k: int = KLL_K) -> DataFrame:
    """``day`` and the sketch ``totals`` of its tickets' totals (those that have one)."""
    rows = sales.where("total IS NOT NULL").select(F.to_date("timestamp").alias("day"), F.col("total").cast("double").alias("total"))
    return rows.groupBy("day").agg(F.kll_sketch_agg_double("total", F.lit(k)).alias("totals"))


def period_fences(daily: DataFrame, periods: DataFrame, iqr_factor: float = 1.5) -> DataFrame:
    """For each of ``periods`` (``first_day``, ``last_day``, both included) from daily sketches: ``n_tickets``,
    ``q1``, ``q3`` and ``upper_fence``. A period without tickets has no row."""
    met = periods.join(daily, daily["day"].between(F.col("first_day"), F.col("last_day")))
    merged = met.groupBy("first_day", "last_day").agg(F.kll_merge_agg_double("totals").alias("totals"))
    quarters = F.kll_sketch_get_quantile_double("totals", F.array(F.lit(0.25), F.lit(0.75)))
    found = merged.select("first_day", "last_day", F.kll_sketch_get_n_double("totals").alias("n_tickets"), quarters.alias("q"))
    q1, q3 = F.col("q")[0], F.col("q")[1]
    return found.select("first_day", "last_day", "n_tickets", q1.alias("q1"), q3.alias("q3"), (q3 + F.lit(float(iqr_factor)) * (q3 - q1)).alias("upper_fence"))


def daily_area_sketches(geo: DataFrame, items: int = ITEMS) -> DataFrame:
    """``day``, ``role``, its pings ``n`` and the sketch ``areas`` of their areas, a missing one included."""
    return geo.groupBy(F.to_date("timestamp").alias("day"), "role").agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k_accumulate(area, {items})").alias("areas"))


def top_areas(daily: DataFrame, items: int = ITEMS) -> DataFrame:
    """Per role over all days of ``daily``: ``total_signals``, the most frequent area ``primary_area`` (of
    equal ones the smaller name, a missing one last) and ``proven``: whether it is sure to be the exact query's.

    If the sketch's numbers add up to all rows nothing was dropped, and they are exact. Otherwise a number
    may be off by ``items_error`` of the rows, and the first must lead by twice that. Where no area is
    frequent enough to be told from the error, ``primary_area`` is null and not proven."""
    merged = daily.groupBy("role").agg(F.sum("n").alias("total_signals"), F.expr(f"approx_top_k_combine(areas, {items})").alias("areas"))
    found = merged.select("role", "total_signals", F.expr(f"approx_top_k_estimate(areas, {items})").alias("found"))
    order = """array_sort(found, (a, b) -> CASE WHEN a.count <> b.count THEN if(a.count > b.count, -1, 1)
        WHEN a.item <=> b.item THEN 0 WHEN a.item IS NULL THEN 1 WHEN b.item IS NULL THEN -1 WHEN a.item < b.item THEN -1 ELSE 1 END)"""
    ranked = found.withColumn("ranked", F.expr(order))
    exact = F.expr("aggregate(ranked, 0L, (s, x) -> s + x.count) = total_signals")
    lead = F.expr("coalesce(get(ranked, 0).count, 0) - coalesce(get(ranked, 1).count, 0)")
    return ranked.select("role", "total_signals", F.expr("get(ranked, 0).item").alias("primary_area"), (exact | (lead > F.lit(2 * items_error(items)) * F.col("total_signals"))).alias("proven"))


def yearly_fence_check(sales: DataFrame, k: int = KLL_K) -> DataFrame:
    """Fences of all calendar years and of the whole time, from stored daily sketches, held against the
    tickets: ``first_day``, ``last_day``, ``n_tickets`` and whether the quartiles' ranks are within
    ``kll_error`` (``q1_within``, ``q3_within``). An approximate quartile is right if the share of smaller totals is
    at most, and that of totals up to it at least, the wanted one, give or take the error."""
    from aislewise.session import materialize

    daily = materialize(daily_total_sketches(sales, k))
    days = daily.where("day IS NOT NULL").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    years = days.select(F.expr("explode(sequence(year(a), year(b)))").alias("y")).selectExpr("make_date(y, 1, 1) AS first_day", "make_date(y, 12, 31) AS last_day")
    fences = materialize(period_fences(daily, years.unionByName(days.select(F.col("a").alias("first_day"), F.col("b").alias("last_day")))))
    # One row a period, so the join with the tickets is by comparison with few rows.
    met = sales.where("total IS NOT NULL").select(F.to_date("timestamp").alias("day"), "total").join(F.broadcast(fences), F.col("day").between(F.col("first_day"), F.col("last_day")))
    share = lambda condition: F.count_if(condition) / F.count(F.lit(1))
    ranks = met.groupBy("first_day", "last_day", "n_tickets").agg(*[share(c).alias(n) for n, c in [("l1", F.col("total") < F.col("q1")), ("u1", F.col("total") <= F.col("q1")), ("l3", F.col("total") < F.col("q3")), ("u3", F.col("total") <= F.col("q3"))]])
    within = lambda low, high, p: (F.col(low) <= p + kll_error(k)) & (F.col(high) >= p - kll_error(k))
    return ranks.select("first_day", "last_day", "n_tickets", within("l1", "u1", 0.25).alias("q1_within"), within("l3", "u3", 0.75).alias("q3_within"))
