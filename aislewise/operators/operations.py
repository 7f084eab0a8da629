"""Operations: app capture rate, delivery monitoring, checkout staffing gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.functions.numeric import ratio, round_half_up
from aislewise.functions.timeparts import hour_of_day, weekday_index, weekday_name, weekday_name_of, whole_minutes
from aislewise.operators.sessions import session_summary
from aislewise.sources.schemas import CHECKOUT_ROLES


def capture_rate(geo: DataFrame, gap_minutes: int = 60, min_minutes: int = 1) -> DataFrame:
    """Pings received versus one expected per minute, over device sessions (new session after a
    gap of more than ``gap_minutes`` whole minutes) lasting more than ``min_minutes``."""
    s = session_summary(geo, ["device_id"], "timestamp", gap_minutes)
    s = s.withColumn("__dur", whole_minutes("session_begin", "session_end")).where(F.col("__dur") > min_minutes)
    return s.agg(
        F.sum("n_rows").alias("total_pings_received"),
        F.sum("__dur").alias("total_expected_pings"),
    ).withColumn("app_performance_score", round_half_up(ratio("total_pings_received", "total_expected_pings"), 2))


def devices_with_role(geo: DataFrame, role: str = "delivery_guy") -> DataFrame:
    return geo.where(F.col("role") == role).select("device_id", "role").distinct().orderBy("device_id")


def devices_by_pattern(
    geo: DataFrame, area: str = "WAREHOUSE", weekdays: tuple[int, ...] = (2, 5), first_hour: int = 5, last_hour: int = 7
) -> DataFrame:
    """Devices seen in ``area`` on the given weekdays (1 = Sunday) between the hours, inclusive."""
    return (
        geo.where(
            (F.col("area") == area)
            & weekday_index("timestamp").isin(*weekdays)
            & hour_of_day("timestamp").between(first_hour, last_hour)
        )
        .select("device_id")
        .distinct()
        .orderBy("device_id")
    )


def missed_deliveries(
    geo: DataFrame,
    weekdays: tuple[int, ...] = (2, 5),
    area: str = "WAREHOUSE",
    first_hour: int = 5,
    last_hour: int = 7,
    ignore_role: str = "security_guy",
) -> DataFrame:
    """Open delivery days (a ping from someone other than security) with no ping in ``area``
    during the delivery window on that date.

    One aggregation per date decides both conditions, so the pings are read and shuffled once
    (the original reads them twice and anti-joins the dates). Both concern the same date, so
    other weekdays are dropped before it."""
    is_open = F.col("role") != ignore_role
    delivered = (F.col("area") == area) & hour_of_day("timestamp").between(first_hour, last_hour)
    flag = lambda cond: F.max(F.when(cond, F.lit(1)).otherwise(F.lit(0)))  # noqa: E731  NULL counts as false
    per_day = geo.where(weekday_index("timestamp").isin(*weekdays)).groupBy(F.to_date("timestamp").alias("missed_date")).agg(
        flag(is_open).alias("__open"), flag(delivered).alias("__delivered")
    )
    return (
        per_day.where((F.col("__open") == 1) & (F.col("__delivered") == 0))
        .select("missed_date", weekday_name("missed_date").alias("day_name"))
        .orderBy("missed_date")
    )


def staffing_gap(
    geo: DataFrame,
    sales: DataFrame,
    gap_minutes: int = 20,
    cashiers_at_registers_only: bool = False,
) -> DataFrame:
    """Registers needed versus cashiers present per weekday and hour.

    Demand is the number of tickets in the slot over the whole period; the time per customer is
    the mean length of checkout sessions (customer pings at the registers, new session after
    ``gap_minutes``) that start in the slot; needed = ceil(demand / (60 / mean minutes)).
    Every side has at most one row per weekday and hour (7 x 24, plus NULL), so all joins
    broadcast.
    """
    checkout = geo.where((F.col("area") == "CASH_REGISTERS") & F.col("role").isin(*CHECKOUT_ROLES)).select(
        "device_id", "timestamp"
    )
    sessions = session_summary(checkout, ["device_id"], "timestamp", gap_minutes)
    durations = sessions.select(
        weekday_index("session_begin").alias("num_day"),
        hour_of_day("session_begin").alias("hour"),
        whole_minutes("session_begin", "session_end").alias("__dur"),
    ).where(F.col("__dur") >= 1)
    avg_time = durations.groupBy("num_day", "hour").agg(F.avg("__dur").alias("__avg"))

    volume = sales.groupBy(
        weekday_index("timestamp").alias("num_day"),
        hour_of_day("timestamp").alias("hour"),
    ).agg(F.count("sale_id").alias("customers_demand"))

    cashiers = geo.where(F.col("role") == "cashier")
    if cashiers_at_registers_only:
        cashiers = cashiers.where(F.col("area") == "CASH_REGISTERS")
    staffed = cashiers.groupBy(weekday_index("timestamp").alias("num_day"), hour_of_day("timestamp").alias("hour")).agg(
        F.countDistinct("device_id").alias("__open")
    )

    needed = F.ceil(F.col("customers_demand") / (F.lit(60) / F.col("__avg")))
    actual = F.coalesce(F.col("__open"), F.lit(0).cast("long"))
    return (
        volume.join(F.broadcast(avg_time), ["num_day", "hour"])
        .join(F.broadcast(staffed), ["num_day", "hour"], "left")
        .select(
            "num_day",
            weekday_name_of("num_day").alias("day_name"),
            "hour",
            "customers_demand",
            round_half_up("__avg", 2).alias("avg_process_time"),
            needed.alias("optimal_registers_needed"),
            actual.alias("actual_registers_open"),
            (actual - needed).alias("staffing_gap"),
        )
        .orderBy("num_day", "hour")
    )
