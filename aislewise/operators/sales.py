"""Point-of-sale metrics: payment and basket mixes, revenue days, visit frequency, ticket outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislewise.functions.numeric import MONEY, money_avg, money_sum, ratio, round_half_up, share_pct
from aislewise.functions.quantiles import counted_percentiles, one_row, percentiles, value_counts
from aislewise.functions.timeparts import hour_of_day, weekday_index
from aislewise.operators.sessions import session_counts
from aislewise.session import materialize
from aislewise.sources.schemas import SEGMENTS, TIME_CATEGORIES, WALK_IN


def payment_mix(sales: DataFrame) -> DataFrame:
    """Tickets per payment method and their share of all tickets (unrounded)."""
    counts = sales.groupBy("payment_method").agg(F.count(F.lit(1)).alias("total"))
    # The window runs over the grouped rows (one per payment method), not over tickets.
    everything = Window.partitionBy()
    return counts.select("payment_method", "total", share_pct("total", F.sum("total").over(everything)).alias("percentage"))


def top_revenue_days(sales: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` dates with the highest revenue; ties broken by the earlier date."""
    return (
        sales.groupBy(F.to_date("timestamp").alias("sale_date"))
        .agg(money_sum("total").alias("daily_revenue"))
        .orderBy(F.desc("daily_revenue"), F.asc("sale_date"))
        .limit(n)
    )


def basket_by_dwell_bucket(sales: DataFrame, width: int = 5, max_minutes: int = 120) -> DataFrame:
    """Mean ticket of identified customers per dwell-time bucket ``[k*width, k*width+width)``."""
    d = F.col("dwell_minutes")
    start = F.floor(d / F.lit(width)) * F.lit(width)
    label = F.concat(start.cast("string"), F.lit("-"), (start + F.lit(width)).cast("string"), F.lit(" min"))
    return (
        sales.where(d.isNotNull() & F.col("customer_id").isNotNull() & (d > 0) & (d <= max_minutes))
        .groupBy(start.alias("sort_key"), label.alias("time_range"))
        .agg(round_half_up(money_avg("total"), 2).alias("average_purchase_amount"))
        .orderBy("sort_key")
    )


def daily_visit_distribution(sales: DataFrame, gap_minutes: int = 60, id_col: str = "customer_id") -> DataFrame:
    """How many separate visits (gap > ``gap_minutes``) a customer makes on one day, as a
    distribution. Tickets without a customer form one group per day, as in the original; each ticket
    without a timestamp is a visit of its own, on an unknown day."""
    rows = sales.select(F.col(id_col).alias("__id"), "timestamp", F.to_date("timestamp").alias("visit_date"))
    visits = session_counts(rows, ["__id", "visit_date"], "timestamp", gap_minutes).withColumnRenamed("n_sessions", "visits_in_one_day")
    cases = visits.groupBy("visits_in_one_day").agg(F.count(F.lit(1)).alias("number_of_cases"))
    everything = Window.partitionBy()  # over the distribution rows only
    return cases.select(
        "visits_in_one_day",
        "number_of_cases",
        round_half_up(share_pct("number_of_cases", F.sum("number_of_cases").over(everything)), 2).alias("percentage"),
    ).orderBy("visits_in_one_day")


def _fence(q1: float | None, q3: float | None, k: float) -> list[float | None]:
    """q1, q3, their distance and the fence."""
    return [None] * 4 if q1 is None or q3 is None else [q1, q3, q3 - q1, q3 + float(k) * (q3 - q1)]


_FENCE = ["q1", "q3", "iqr", "upper_fence"]


def iqr_fence(sales: DataFrame, k: float = 1.5, exact: bool = True) -> DataFrame:
    """One row: q1, q3, iqr, upper_fence = q3 + k * (q3 - q1) of ``total``. The exact form runs its jobs
    when it is called."""
    if exact:
        return one_row(sales, _fence(*counted_percentiles(materialize(value_counts(sales, "total")), [0.25, 0.75]), k), _FENCE)
    q = percentiles(sales, "total", [0.25, 0.75], ["q1", "q3"], exact=False)
    return q.select(
        "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), (F.col("q3") + F.lit(float(k)) * (F.col("q3") - F.col("q1"))).alias("upper_fence")
    )


def ticket_outliers(sales: DataFrame, k: float = 1.5, exact: bool = True) -> DataFrame:
    """Average ticket with and without the tickets above the IQR fence, and their count.

    Everything comes from the table of distinct totals and their numbers, which the percentiles
    need anyway: it is written when the operator is called, and the tickets are read and shuffled once."""
    counts = value_counts(sales, "total")
    if exact:
        counts = materialize(counts)
        fence = one_row(sales, _fence(*counted_percentiles(counts, [0.25, 0.75]), k), _FENCE).select("upper_fence")
    else:
        fence = iqr_fence(sales, k, exact).select("upper_fence")
    # decimal(26,9) * decimal(11,0) is decimal(38,9): exact
    amount = F.col("__x").cast("decimal(26,9)") * F.col("__c").cast("decimal(11,0)")
    inside = F.col("__x") <= F.col("upper_fence")

    def mean(condition=None):
        s, n = (amount, F.col("__c")) if condition is None else (F.when(condition, amount), F.when(condition, F.col("__c")))
        return ratio(F.sum(s), F.sum(n))

    return counts.crossJoin(F.broadcast(fence)).agg(  # one row
        mean().alias("avg_with_outliers"),
        mean(inside).alias("avg_without_outliers"),
        F.coalesce(F.sum(F.when(F.col("__x") > F.col("upper_fence"), F.col("__c"))), F.lit(0).cast("long")).alias("outliers_count"),
        F.max("upper_fence").alias("threshold_value"),
    )


def whale_demographics(sales: DataFrame, geo: DataFrame, k: float = 1.5, exact: bool = True) -> DataFrame:
    """Tickets above the fence broken down by the role of the device that paid.

    Whale tickets are first reduced to one row per customer (anonymous tickets to a single
    row), so the join with the device roles sees each customer once however many whale
    tickets it has, and no key is hot. A device listed with two roles counts under both, as
    with the original left join; a missing or NULL role is reported as the walk-in label.
    """
    fence = iqr_fence(sales, k, exact).select("upper_fence")
    whales = sales.select("customer_id", "sale_id", "total").crossJoin(F.broadcast(fence)).where(  # one row
        F.col("total") > F.col("upper_fence")
    )
    per_customer = whales.groupBy("customer_id").agg(
        F.count("sale_id").alias("n"),
        F.sum(F.col("total").cast(MONEY)).alias("s"),
        F.count("total").alias("nt"),
        F.max("total").alias("mx"),
    )
    roles = geo.where(F.col("device_id").isNotNull()).select("device_id", "role").distinct()
    by_role = (
        per_customer.join(roles, F.col("customer_id") == F.col("device_id"), "left")
        .groupBy(F.coalesce(F.col("role"), F.lit(WALK_IN)).alias("customer_role"))
        .agg(
            F.sum("n").alias("total_txns"),
            ratio(F.sum("s"), F.sum("nt")).alias("__avg"),
            F.max("mx").alias("__max"),
        )
    )
    everything = Window.partitionBy()  # over the per-role rows only
    return by_role.select(
        "customer_role",
        "total_txns",
        round_half_up(share_pct("total_txns", F.sum("total_txns").over(everything)), 1).alias("share_of_whales_pct"),
        round_half_up("__avg", 0).alias("avg_ticket_size"),
        round_half_up("__max", 0).alias("max_ticket_size"),
    ).orderBy(F.desc("total_txns"))


def top_spenders(sales: DataFrame, n: int = 5) -> DataFrame:
    """Identified customers with the largest total spend; ties broken by id."""
    return (
        sales.where(F.col("customer_id").isNotNull())
        .groupBy(F.col("customer_id").alias("device_id"))
        .agg(round_half_up(money_sum("total"), 2).alias("total_expenses"))
        .orderBy(F.desc("total_expenses"), F.asc("device_id"))
        .limit(n)
    )


def _segment(avg_basket):
    small, medium, large, whale = SEGMENTS
    return (
        F.when(avg_basket < 300, F.lit(small))
        .when(avg_basket.between(300, 800), F.lit(medium))
        .when(avg_basket.between(800, 1139), F.lit(large))
        .otherwise(F.lit(whale))
    )


def time_category(ts: str = "timestamp"):
    peak, off_peak, regular = TIME_CATEGORIES
    dow = weekday_index(ts)
    return (
        F.when(dow.isin(5, 6), F.lit(peak))
        .when(hour_of_day(ts).between(14, 17) & (dow < 5), F.lit(off_peak))
        .otherwise(F.lit(regular))
    )


def basket_mix_peak_offpeak(sales: DataFrame) -> DataFrame:
    """Tickets of identified customers per (time category, customer segment) with the share inside
    each category. Segment comes from the customer's mean ticket over all its tickets.

    One aggregation per customer yields both its mean ticket and its ticket counts per category,
    so no join of tickets back to customer profiles is needed."""
    peak, off_peak, _ = TIME_CATEGORIES
    cat = time_category()
    per_customer = (
        sales.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            money_avg("total").alias("__avg"),
            F.count_if(cat == peak).alias("__peak"),
            F.count_if(cat == off_peak).alias("__off"),
        )
    )
    per_category = per_customer.select(
        _segment(F.col("__avg")).alias("customer_segment"),
        F.explode(
            F.array(
                F.struct(F.lit(peak).alias("c"), F.col("__peak").alias("n")),
                F.struct(F.lit(off_peak).alias("c"), F.col("__off").alias("n")),
            )
        ).alias("__x"),
    ).where(F.col("__x.n") > 0)
    counts = per_category.groupBy(F.col("__x.c").alias("time_category"), "customer_segment").agg(
        F.sum("__x.n").alias("num_sales")
    )
    in_category = Window.partitionBy("time_category")  # at most 2 x 4 rows
    return counts.select(
        "time_category",
        "customer_segment",
        "num_sales",
        round_half_up(share_pct("num_sales", F.sum("num_sales").over(in_category)), 2).alias("share_pct"),
    ).orderBy("time_category", "customer_segment")


def dwell_vs_spend(sales: DataFrame, min_dwell: int = 1, max_dwell: int = 180, ordered: bool = True) -> DataFrame:
    """Regression input rows: identified customers, ``min_dwell < dwell < max_dwell``, positive ticket.

    ``ordered`` adds the original's presentation sort; consumers that aggregate pass False,
    since Catalyst keeps a sort below an aggregate."""
    d = F.col("dwell_minutes")
    rows = sales.where(
        F.col("customer_id").isNotNull() & d.isNotNull() & (d > min_dwell) & (d < max_dwell) & (F.col("total") > 0)
    ).select("dwell_minutes", F.col("total").alias("purchase_amount"), round_half_up(F.col("total") / d, 2).alias("dollars_per_minute"))
    # Ordered by dwell as in the original; the amount as second key keeps the range sort
    # splittable when a few dwell values hold most rows.
    return rows.orderBy("dwell_minutes", "purchase_amount") if ordered else rows
