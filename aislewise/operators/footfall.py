"""Footfall: visitor counts by weekday, hour and week, frequent visitors, traffic heatmap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.functions.numeric import ratio, round_half_up
from aislewise.functions.timeparts import hour_of_day, sunday_week, sunday_week_start, weekday_index, weekday_name_of
from aislewise.sources.schemas import FOOT_TRAFFIC_ROLES, VISITOR_ROLES


def daily_visitors(geo: DataFrame) -> DataFrame:
    """Distinct devices per weekday over the whole period, Sunday first."""
    return (
        geo.groupBy(weekday_index("timestamp").alias("__dow"))
        .agg(F.countDistinct("device_id").alias("unique_visitors"))
        .orderBy("__dow")
        .select(weekday_name_of("__dow").alias("day_name"), "unique_visitors")
    )


def traffic_heatmap(geo: DataFrame) -> DataFrame:
    """Per weekday and hour: distinct devices seen in the slot over the whole period divided by the
    number of distinct dates with a ping in that slot, rounded to one digit.

    The pings first collapse to distinct (device, date, hour), combined map-side; the two distinct
    counts then expand those rows, not the pings. The day's name is made from the result's rows."""
    # Counted, not only made distinct: Catalyst drops a plain distinct below distinct counts.
    seen = geo.groupBy("device_id", F.to_date("timestamp").alias("__d"), hour_of_day("timestamp").alias("hour_of_day")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    seen = seen.where("__n > 0")
    slots = seen.groupBy(weekday_index("__d").alias("day_sort"), "hour_of_day").agg(
        round_half_up(ratio(F.countDistinct("device_id"), F.countDistinct("__d")), 1).alias("avg_visitors")
    )
    return slots.select(weekday_name_of("day_sort").alias("day_name"), "day_sort", "hour_of_day", "avg_visitors").orderBy(
        "day_sort", "hour_of_day"
    )


def top_frequent_customers(geo: DataFrame, n: int = 5, role: str = "repeat_customer") -> DataFrame:
    """Devices of ``role`` with the most distinct visit days; ties broken by device_id."""
    return (
        geo.where(F.col("role") == role)
        .groupBy("device_id")
        .agg(F.countDistinct(F.to_date("timestamp")).alias("arrival_days_count"))
        .orderBy(F.desc("arrival_days_count"), F.asc("device_id"))
        .limit(n)
    )


def foot_traffic(geo: DataFrame, sales: DataFrame) -> DataFrame:
    """Distinct people per weekday and hour: visitor pings plus every ticket (customer id, or the
    ticket id for customers without the app)."""
    visitors = geo.where(F.col("role").isin(*FOOT_TRAFFIC_ROLES)).select(
        "timestamp", F.col("device_id").alias("distinct_user_id")
    )
    buyers = sales.select("timestamp", F.coalesce("customer_id", "sale_id").alias("distinct_user_id"))
    slots = (
        visitors.unionByName(buyers)
        .groupBy(weekday_index("timestamp").alias("day_index"), hour_of_day("timestamp").alias("hour_of_day"))
        .agg(F.countDistinct("distinct_user_id").alias("total_foot_traffic"))
    )
    return slots.select(weekday_name_of("day_index").alias("day_name"), "day_index", "hour_of_day", "total_foot_traffic").orderBy(
        "day_index", "hour_of_day"
    )


def weekly_visitors(geo: DataFrame, ordered: bool = True) -> DataFrame:
    """Distinct visitor devices per Sunday-based week (week 0..53 and its Sunday)."""
    weeks = (
        geo.where(F.col("role").isin(*VISITOR_ROLES))
        .groupBy(sunday_week("timestamp").alias("week_number"), sunday_week_start("timestamp").alias("week_start_date"))
        .agg(F.countDistinct("device_id").alias("unique_visitors_count"))
    )
    return weeks.orderBy("week_number") if ordered else weeks
