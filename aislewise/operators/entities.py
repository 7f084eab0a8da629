"""Entities: visitor and staff rosters, rule-based role classification, signal accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislewise.functions.numeric import ratio, round_half_up
from aislewise.functions.timeparts import whole_minutes
from aislewise.session import materialize
from aislewise.sources.schemas import NO_PHONE, STAFF_AREA_ROLE, STAFF_ROLES, STATIC_ROLE_AREA, VISITOR_ROLES


def visitor_roster(sales: DataFrame, geo: DataFrame, materialize_devices: bool = True) -> DataFrame:
    """Distinct (final_user_id, customer_type) for visitors and app-less buyers.

    Same rows as ``sales FULL JOIN geo ON customer_id = device_id`` filtered to visitor roles or
    unmatched tickets, then DISTINCT; but no pings-by-tickets join is ever formed:
    * a visitor device contributes (device, role) whether or not it bought;
    * a ticket without a customer contributes (sale_id, no_phone);
    * an identified customer never seen by a device contributes (customer_id, no_phone),
      found with an anti join of distinct customers against distinct devices;
    * a ping without a device id would contribute (NULL, no_phone).

    With ``materialize_devices`` a job writes the distinct (device, role) when this function is
    called, and the result is a snapshot of the pings at that time; without it, all is lazy.
    """
    # One pass over the pings: distinct (device, role), device-sized, is written once and feeds
    # all three device-side parts (otherwise each part's filter, pushed below the distinct,
    # would make Spark scan the pings again).
    device_roles = geo.select("device_id", "role").distinct()
    if materialize_devices:
        device_roles = materialize(device_roles)
    visitors = device_roles.where(F.col("role").isin(*VISITOR_ROLES) & F.col("device_id").isNotNull()).select(
        F.col("device_id").alias("final_user_id"), F.col("role").alias("customer_type")
    )
    devices = device_roles.where(F.col("device_id").isNotNull()).select(F.col("device_id").alias("customer_id")).distinct()
    customers = sales.where(F.col("customer_id").isNotNull()).select("customer_id").distinct()
    unseen = customers.join(devices, "customer_id", "left_anti").select(
        F.col("customer_id").alias("final_user_id"), F.lit(NO_PHONE).alias("customer_type")
    )
    anonymous = sales.where(F.col("customer_id").isNull()).select(
        F.col("sale_id").alias("final_user_id"), F.lit(NO_PHONE).alias("customer_type")
    )
    no_device = device_roles.where(F.col("device_id").isNull()).select(
        F.lit(None).cast("string").alias("final_user_id"), F.lit(NO_PHONE).alias("customer_type")
    )
    return (
        visitors.unionByName(unseen).unionByName(anonymous).unionByName(no_device).distinct()
        # Ordered by type as in the original; the id as second key lets the range partitioner
        # split a type (one row per anonymous ticket can be most of the output).
        .orderBy("customer_type", "final_user_id")
    )


def staff_roster(geo: DataFrame) -> DataFrame:
    """Distinct staff (device, role) with the number of distinct devices in the role."""
    staff = geo.where(F.col("role").isin(*STAFF_ROLES)).select("device_id", "role").distinct()
    # At most one row per staff role (seven), so the broadcast is bounded.
    heads = staff.groupBy("role").agg(F.count("device_id").alias("total_in_department"))
    return staff.join(F.broadcast(heads), "role").select("device_id", "role", "total_in_department").orderBy("role", "device_id")


def device_profiles(geo: DataFrame) -> DataFrame:
    """One row per device: day count, whole minutes on site, first/last day, first ping, home area.

    Home area is the area with most pings (ties: the smaller area name). All aggregates are
    partial (map-side) so a device with a huge share of the pings is still spread over tasks.
    """
    pieces = (
        geo.where(F.col("device_id").isNotNull())
        .groupBy("device_id", F.to_date("timestamp").alias("d"), "area")
        .agg(F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"), F.count(F.lit(1)).alias("n"))
    )
    # Each (device, day, area) counts for its day and for its area. Both roll-ups go through one
    # aggregate, so that the pings are read and shuffled once.
    both = pieces.selectExpr(
        "device_id",
        """inline(array(named_struct('by_day', true, 'd', d, 'area', CAST(NULL AS STRING), 't0', t0, 't1', t1, 'n', 0L),
                        named_struct('by_day', false, 'd', CAST(NULL AS DATE), 'area', area, 't0', CAST(NULL AS TIMESTAMP_NTZ), 't1', CAST(NULL AS TIMESTAMP_NTZ), 'n', n)))""",
    )
    parts = both.groupBy("device_id", "by_day", "d", "area").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("n").alias("n"))
    minutes = whole_minutes("t0", "t1")
    rank = F.when(~F.col("by_day"), F.struct((-F.col("n")).alias("most"), F.col("area").isNull().alias("none"), F.col("area").alias("area")))
    return parts.groupBy("device_id").agg(
        F.sum(minutes).alias("on_site_minutes"),
        F.count(minutes).alias("timed_days"),
        F.count("d").alias("visit_days"),
        F.min("d").alias("first_day"),
        F.max("d").alias("last_day"),
        F.min("t0").alias("first_seen"),
        F.min(rank)["area"].alias("main_area"),
    )


def classify_entities(
    geo: DataFrame,
    sales: DataFrame,
    staff_hours: float = 3,
    restricted_areas: tuple[str, ...] = ("WAREHOUSE", "HEAD_OFFICE"),
    max_avg_gap_days: float = 12,
    min_tenure_days: int = 60,
    min_visits: int = 10,
    materialize_profiles: bool = True,
    identified: DataFrame | None = None,
) -> DataFrame:
    """Classify every device into a staff or visitor role, plus one ``no_phone`` row per
    anonymous ticket. Rules, first match wins:

    1. mean daily hours >= ``staff_hours`` or home area in ``restricted_areas``: staff role from
       the home area (SUPERMARKET: senior_general_worker for the device seen first among all
       devices whose home is SUPERMARKET, else general_worker);
    2. never a paying customer: not_paying;
    3. mean gap between visit days <= ``max_avg_gap_days``, first-to-last calendar days >=
       ``min_tenure_days`` and >= ``min_visits`` visit days: repeat_customer;
    4. otherwise one_time_customer.

    The mean of daily hours and the mean gap are tested exactly on integers: the mean daily
    hours is ``minutes / (60 * days)`` and consecutive day gaps telescope to
    ``(last_day - first_day) / (days - 1)``.

    The device profile (one row per device) is read twice, for the rules and for the
    supermarket's first-seen time; with ``materialize_profiles`` a job writes it to the
    checkpoint folder when this function is called, so the pings are aggregated once. The result
    is then a snapshot of the pings at that time; without it, all of it is lazy. ``identified`` may give
    the tickets with a customer from a table of their own (``sources.bucketed``).
    """
    p = device_profiles(geo)
    if materialize_profiles:
        p = materialize(p)
    supermarket_first = p.where(F.col("main_area") == "SUPERMARKET").agg(
        F.min("first_seen").alias("__sup_first"),
        F.count_if(F.col("first_seen").isNull()).alias("__sup_null"),
    )
    paying = (sales if identified is None else identified).where(F.col("customer_id").isNotNull()).select(F.col("customer_id").alias("device_id")).distinct().withColumn(
        "__pays", F.lit(True)
    )
    u = p.crossJoin(F.broadcast(supermarket_first)).join(paying, "device_id", "left")  # one-row broadcast

    area = F.col("main_area")
    staff = (F.col("on_site_minutes") >= F.lit(60 * staff_hours) * F.col("timed_days")) | area.isin(*restricted_areas)
    # RANK() ... ORDER BY first ping ASC puts devices without a timestamp first.
    senior = F.when(F.col("__sup_null") > 0, F.col("first_seen").isNull()).otherwise(
        F.col("first_seen") == F.col("__sup_first")
    )
    staff_role = None
    for a, r in STAFF_AREA_ROLE.items():
        staff_role = F.when(area == a, F.lit(r)) if staff_role is None else staff_role.when(area == a, F.lit(r))
    staff_role = staff_role.when(
        area == "SUPERMARKET", F.when(senior, F.lit("senior_general_worker")).otherwise(F.lit("general_worker"))
    ).otherwise(F.lit("general_worker"))
    n = F.col("visit_days")
    repeat = (
        (n > 1)
        & ((F.datediff("last_day", "first_day")) <= F.lit(max_avg_gap_days) * (n - 1))
        & (F.datediff("last_day", "first_day") >= min_tenure_days)
        & (n >= min_visits)
    )
    role = (
        F.when(staff, staff_role)
        .when(F.col("__pays").isNull(), F.lit("not_paying"))
        .when(repeat, F.lit("repeat_customer"))
        .otherwise(F.lit("one_time_customer"))
    )
    devices = u.select(F.col("device_id").cast("string").alias("final_user_id"), role.alias("final_calculated_role"))
    anonymous = sales.where(F.col("customer_id").isNull()).select(
        F.col("sale_id").cast("string").alias("final_user_id"), F.lit(NO_PHONE).alias("final_calculated_role")
    )
    return devices.unionByName(anonymous).orderBy("final_calculated_role", "final_user_id")


def signal_accuracy(geo: DataFrame, max_m: float = 30) -> DataFrame:
    """Share of pings whose accuracy radius exceeds ``max_m`` metres."""
    return geo.agg(
        F.count(F.lit(1)).alias("total_signals"),
        F.count_if(F.col("accuracy_m") > max_m).alias("outlier_signals"),
    ).withColumn("outlier_ratio", round_half_up(ratio("outlier_signals", "total_signals"), 2))


def signal_accuracy_by_role(geo: DataFrame, max_m: float = 30, exact: bool = True) -> DataFrame:
    """Per role: pings, inaccurate pings, their ratio and the most frequent area (NULL counts as an
    area; ties go to the smaller name). One aggregation by (role, area) feeds everything.

    ``exact=False`` takes the most frequent area from the ``approx_top_k`` sketch instead, in a
    single aggregation by role (the original used an approximate top-count too)."""
    if not exact:
        return (
            geo.groupBy("role")
            .agg(
                F.count(F.lit(1)).alias("total_signals"),
                F.count_if(F.col("accuracy_m") > max_m).alias("outlier_signals"),
                F.expr("approx_top_k(area, 1)[0].item").alias("primary_area"),
            )
            .select(
                "role",
                "total_signals",
                "outlier_signals",
                round_half_up(ratio("outlier_signals", "total_signals"), 2).alias("outlier_ratio"),
                "primary_area",
            )
            .orderBy(F.desc("outlier_ratio"))
        )
    ra = geo.groupBy("role", "area").agg(
        F.count(F.lit(1)).alias("__n"), F.count_if(F.col("accuracy_m") > max_m).alias("__o")
    )
    by_role = Window.partitionBy("role")  # over (role, area) groups only
    ranked = by_role.orderBy(F.desc("__n"), F.asc_nulls_last("area"))
    return (
        ra.select(
            "role",
            F.sum("__n").over(by_role).alias("total_signals"),
            F.sum("__o").over(by_role).alias("outlier_signals"),
            F.col("area").alias("primary_area"),
            F.row_number().over(ranked).alias("__rn"),
        )
        .where(F.col("__rn") == 1)
        .select(
            "role",
            "total_signals",
            "outlier_signals",
            round_half_up(ratio("outlier_signals", "total_signals"), 2).alias("outlier_ratio"),
            "primary_area",
        )
        .orderBy(F.desc("outlier_ratio"))
    )


def impute_area(geo: DataFrame, max_m: float = 30, only_imputed: bool = True) -> DataFrame:
    """Add ``spatial_area_fixed``: the reported area for accurate pings, the fixed post of a static
    role (security, butcher, cashier) for inaccurate ones. Other inaccurate pings are dropped.
    With ``only_imputed`` only the inaccurate, imputed pings are returned."""
    acc = F.col("accuracy_m")
    role = F.col("role")
    fixed = F.when(acc <= max_m, F.col("area"))
    for r, a in STATIC_ROLE_AREA.items():
        fixed = fixed.when((acc > max_m) & (role == r), F.lit(a))
    keep = (acc <= max_m) | ((acc > max_m) & role.isin(*STATIC_ROLE_AREA))
    if only_imputed:
        keep = keep & (acc > max_m)
    return geo.where(keep).withColumn("spatial_area_fixed", fixed.otherwise(F.lit(None).cast("string")))
