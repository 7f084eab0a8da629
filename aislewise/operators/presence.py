"""Exact distinct counts at many grains from one table of bitmaps.

People (devices, customers, tickets without a customer) are numbered once; a row of the table is a date, an hour,
a kind of presence and a bucket of 32,768 numbers, with a bitmap of who was there. Any coarser grain
(weekday, week, slot of a weekday and hour) is the OR of such bitmaps and a count of bits: the pings are scanned
once, for all answers, and a new day is added by appending its bitmaps. The size does not depend on the number of
pings: at most 4 KB for 32,768 people, date, hour and kind.

Numbers are dense within a partition, which is all that buckets need, so numbering takes no global sort. New people
get numbers behind the known ones, in buckets of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.functions.numeric import ratio, round_half_up
from aislewise.functions.timeparts import hour_of_day, sunday_week, sunday_week_start, weekday_index, weekday_name_of
from aislewise.session import materialize
from aislewise.sources.schemas import FOOT_TRAFFIC_ROLES, VISITOR_ROLES

#: Kinds of presence: pings of roles in both lists, of those in foot traffic only, in visitors only, of all others;
#: tickets.
BOTH, TRAFFIC, VISITOR, OTHER, TICKET = range(5)
_BUCKET = 32_768


def seen(geo: DataFrame, sales: DataFrame) -> DataFrame:
    """Distinct (``person``, ``day``, ``hour``, ``kind``) of pings and tickets, combined map-side."""
    visitor, traffic = (F.coalesce(F.col("role").isin(*roles), F.lit(False)) for roles in (VISITOR_ROLES, FOOT_TRAFFIC_ROLES))
    kind = F.when(visitor & traffic, BOTH).when(traffic, TRAFFIC).when(visitor, VISITOR).otherwise(OTHER)
    pings = geo.select(F.col("device_id").alias("person"), "timestamp", kind.alias("kind"))
    tickets = sales.select(F.coalesce("customer_id", "sale_id").alias("person"), "timestamp", F.lit(TICKET).alias("kind"))
    rows = pings.unionByName(tickets).select("person", F.to_date("timestamp").alias("day"), hour_of_day("timestamp").alias("hour"), "kind")
    return rows.distinct()


def numbered(people: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``person`` and ``number`` of all distinct people, written: those in ``known`` keep their numbers. A
    missing person has no number."""
    new, behind = people.select("person").where("person IS NOT NULL").distinct(), 0
    if known is not None:
        new = new.join(known, "person", "left_anti")
        last = known.agg(F.max("number")).first()[0]
        behind = 0 if last is None else (last // _BUCKET + 1) * _BUCKET
    made = new.withColumn("number", F.monotonically_increasing_id() + F.lit(behind))
    return materialize(made if known is None else known.unionByName(made))


def bitmaps(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """``day``, ``hour``, ``kind``, ``bucket`` and the bitmap ``people`` of the rows of ``seen``; a slot seen by
    missing persons only has a row without bucket, as it counts as a date with pings."""
    met = rows.join(numbers, "person", "left").select("day", "hour", "kind", F.expr("bitmap_bucket_number(number) AS bucket"), F.expr("bitmap_bit_position(number) AS bit"))
    return met.groupBy("day", "hour", "kind", "bucket").agg(F.bitmap_construct_agg("bit").alias("people"))


def presence_table(geo: DataFrame, sales: DataFrame) -> DataFrame:
    """The table of bitmaps over all pings and tickets, written."""
    rows = materialize(seen(geo, sales))
    return materialize(bitmaps(rows, numbered(rows)))


def _people(table: DataFrame, *grain: Column) -> DataFrame:
    """Distinct people per grain: bitmaps of a bucket become one, then bits are counted."""
    names = [f"g{i}" for i in range(len(grain))]
    rows = table.select(*[g.alias(n) for g, n in zip(grain, names, strict=True)], "bucket", "people")
    merged = rows.groupBy(*names, "bucket").agg(F.bitmap_or_agg("people").alias("people"))
    bits = F.when(F.col("bucket").isNotNull(), F.expr("bitmap_count(people)")).otherwise(F.lit(0))
    return merged.groupBy(*names).agg(F.sum(bits).cast("long").alias("people"))


def daily_visitors(table: DataFrame) -> DataFrame:
    """As ``footfall.daily_visitors``."""
    found = _people(table.where(F.col("kind") != TICKET), weekday_index("day"))
    return found.orderBy("g0").select(weekday_name_of("g0").alias("day_name"), F.col("people").alias("unique_visitors"))


def traffic_heatmap(table: DataFrame) -> DataFrame:
    """As ``footfall.traffic_heatmap``."""
    pings = table.where(F.col("kind") != TICKET)
    days = pings.groupBy(weekday_index("day").alias("day_sort"), F.col("hour").alias("hour_of_day")).agg(F.countDistinct("day").alias("days"))
    people = _people(pings, weekday_index("day"), F.col("hour"))
    met = days.join(people, days["day_sort"].eqNullSafe(people["g0"]) & days["hour_of_day"].eqNullSafe(people["g1"]))
    average = round_half_up(ratio("people", "days"), 1).alias("avg_visitors")
    return met.select(weekday_name_of("day_sort").alias("day_name"), "day_sort", "hour_of_day", average).orderBy("day_sort", "hour_of_day")


def foot_traffic(table: DataFrame) -> DataFrame:
    """As ``footfall.foot_traffic``."""
    found = _people(table.where(F.col("kind").isin(BOTH, TRAFFIC, TICKET)), weekday_index("day"), F.col("hour"))
    return found.select(weekday_name_of("g0").alias("day_name"), F.col("g0").alias("day_index"), F.col("g1").alias("hour_of_day"), F.col("people").alias("total_foot_traffic")).orderBy("day_index", "hour_of_day")


def weekly_visitors(table: DataFrame) -> DataFrame:
    """As ``footfall.weekly_visitors``."""
    found = _people(table.where(F.col("kind").isin(BOTH, VISITOR)), sunday_week("day"), sunday_week_start("day"))
    return found.select(F.col("g0").alias("week_number"), F.col("g1").alias("week_start_date"), F.col("people").alias("unique_visitors_count")).orderBy("week_number")


def all_answers(geo: DataFrame, sales: DataFrame) -> DataFrame:
    """The four answers from one table, as rows of ``answer``, ``day_index``, ``hour_of_day``, ``week_start_date`` and
    ``value``."""
    table = presence_table(geo, sales)
    index = F.expr("cast(array_position(array('Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday'), day_name) AS int)")
    shape = lambda df, answer, value, **columns: df.select(F.lit(answer).alias("answer"), *[columns.get(c, F.lit(None).cast(t)).alias(c) for c, t in [("day_index", "int"), ("hour_of_day", "int"), ("week_start_date", "date")]], F.col(value).cast("double").alias("value"))
    hour, week = F.col("hour_of_day"), F.col("week_start_date")
    parts = [
        shape(daily_visitors(table), "daily_visitors", "unique_visitors", day_index=index),
        shape(traffic_heatmap(table), "traffic_heatmap", "avg_visitors", day_index=F.col("day_sort"), hour_of_day=hour),
        shape(foot_traffic(table), "foot_traffic", "total_foot_traffic", day_index=F.col("day_index"), hour_of_day=hour),
        shape(weekly_visitors(table), "weekly_visitors", "unique_visitors_count", week_start_date=week),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
