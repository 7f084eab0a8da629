"""Distinct counts from bitmaps against the operators that count the rows."""

from aislewise.operators import footfall
from aislewise.operators import presence as P
from aislewise.session import materialize


def rows(df):
    return sorted(map(str, df.collect()))


def test_equal_to_the_queries(spark, tables):
    table = P.presence_table(tables.geo, tables.sales)
    assert rows(P.daily_visitors(table)) == rows(footfall.daily_visitors(tables.geo))
    assert rows(P.traffic_heatmap(table)) == rows(footfall.traffic_heatmap(tables.geo))
    assert rows(P.foot_traffic(table)) == rows(footfall.foot_traffic(tables.geo, tables.sales))
    assert rows(P.weekly_visitors(table)) == rows(footfall.weekly_visitors(tables.geo))


def odd_tables(spark, n, people):
    role = "element_at(array('customer', 'not_paying', 'repeat_customer', 'cashier', NULL), cast(id % 5 + 1 as int))"
    at = "timestampadd(MINUTE, cast(id * 7919 % 60000 as int), timestamp_ntz'2023-12-28 00:00:00')"
    geo = spark.range(n).selectExpr(f"if(id % 11 = 0, NULL, concat('d', cast(id * 31 % {people} as string))) AS device_id", f"if(id % 97 = 0, NULL, {at}) AS timestamp", f"{role} AS role")
    sales = spark.range(n // 4).selectExpr("concat('s', id) AS sale_id", f"if(id % 3 = 0, NULL, concat('d', cast(id * 17 % {people} as string))) AS customer_id", f"if(id % 89 = 0, NULL, {at}) AS timestamp")
    return geo, sales


def test_nulls_and_several_buckets(spark):
    """Over 32,768 people, so several bitmaps a slot; missing devices, times and roles."""
    geo, sales = odd_tables(spark, 200_000, 90_001)
    table = P.presence_table(geo, sales)
    assert table.select("bucket").distinct().count() > 3
    assert rows(P.daily_visitors(table)) == rows(footfall.daily_visitors(geo))
    assert rows(P.traffic_heatmap(table)) == rows(footfall.traffic_heatmap(geo))
    assert rows(P.foot_traffic(table)) == rows(footfall.foot_traffic(geo, sales))
    assert rows(P.weekly_visitors(table)) == rows(footfall.weekly_visitors(geo))
    assert P.all_answers(geo.limit(0), sales.limit(0)).count() == 0


def test_new_days_are_appended(spark):
    """Bitmaps of a new part beside those of the old one, without reading the old rows again."""
    geo, sales = odd_tables(spark, 20_000, 3000)
    early, late = (geo.where(c) for c in ("timestamp < '2024-01-20' OR timestamp IS NULL", "timestamp >= '2024-01-20'"))
    sales_early, sales_late = (sales.where(c) for c in ("timestamp < '2024-01-20' OR timestamp IS NULL", "timestamp >= '2024-01-20'"))
    first = materialize(P.seen(early, sales_early))
    known = P.numbered(first)
    more = materialize(P.seen(late, sales_late))
    numbers = P.numbered(more, known)
    assert numbers.groupBy("person").count().where("count > 1").count() == 0 and numbers.select("number").distinct().count() == numbers.count()
    assert numbers.join(known, ["person", "number"]).count() == known.count()
    table = P.bitmaps(first, known).unionByName(P.bitmaps(more, numbers))
    assert rows(P.foot_traffic(table)) == rows(footfall.foot_traffic(geo, sales))
    assert rows(P.weekly_visitors(table)) == rows(footfall.weekly_visitors(geo))
    assert rows(P.traffic_heatmap(table)) == rows(footfall.traffic_heatmap(geo))


def test_one_scan_of_the_pings(spark, tables):
    """The table is made from one pass; answers read bitmaps only."""
    plan = P.seen(tables.geo, tables.sales)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("events.parquet") == 1
    answer = P.weekly_visitors(P.presence_table(tables.geo, tables.sales))._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in answer
