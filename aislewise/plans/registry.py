"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each callable derives the canonical tables from the driver's test tables and
applies one operator with its default parameters over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aislewise.operators import entities, footfall, incremental, market, operations, presence, regression, sales, sketches
from aislewise.session import scratch_path
from aislewise.sources import marts
from aislewise.sources.tables import RetailTables, derive_from_driver_tables
from aislewise.streaming import complete, live

# The city the market queries look at. The original studies one town; on the test tables the
# cities are nation names, and this one has branches at every scale.
STORE_CITY = "NATION_15"

Query = Callable[[SparkSession, str], DataFrame]


# name -> operator over canonical tables, with the default parameters
OPS: dict[str, Callable[[RetailTables], DataFrame]] = {
    "daily_visitors": lambda t: footfall.daily_visitors(t.geo),
    "payment_mix": lambda t: sales.payment_mix(t.sales),
    "top_revenue_days": lambda t: sales.top_revenue_days(t.sales),
    "basket_by_dwell_bucket": lambda t: sales.basket_by_dwell_bucket(t.sales),
    "traffic_heatmap": lambda t: footfall.traffic_heatmap(t.geo),
    "market_saturation": lambda t: market.market_saturation(t.city, t.branches),
    "visitor_roster": lambda t: entities.visitor_roster(t.sales, t.geo),
    "staff_roster": lambda t: entities.staff_roster(t.geo),
    "classify_entities": lambda t: entities.classify_entities(t.geo, t.sales),
    "signal_accuracy": lambda t: entities.signal_accuracy(t.geo),
    "signal_accuracy_by_role": lambda t: entities.signal_accuracy_by_role(t.geo),
    "impute_area": lambda t: entities.impute_area(t.geo),
    "daily_visit_distribution": lambda t: sales.daily_visit_distribution(t.sales),
    "capture_rate": lambda t: operations.capture_rate(t.geo),
    "ticket_outliers": lambda t: sales.ticket_outliers(t.sales),
    "whale_demographics": lambda t: sales.whale_demographics(t.sales, t.geo),
    "devices_with_role": lambda t: operations.devices_with_role(t.geo),
    "devices_by_pattern": lambda t: operations.devices_by_pattern(t.geo),
    "missed_deliveries": lambda t: operations.missed_deliveries(t.geo),
    "top_frequent_customers": lambda t: footfall.top_frequent_customers(t.geo),
    "top_spenders": lambda t: sales.top_spenders(t.sales),
    "foot_traffic": lambda t: footfall.foot_traffic(t.geo, t.sales),
    "basket_mix_peak_offpeak": lambda t: sales.basket_mix_peak_offpeak(t.sales),
    "staffing_gap": lambda t: operations.staffing_gap(t.geo, t.sales),
    "weekly_visitors": lambda t: footfall.weekly_visitors(t.geo),
    "dwell_vs_spend": lambda t: sales.dwell_vs_spend(t.sales),
    "estimated_households": lambda t: market.estimated_households(t.city, STORE_CITY),
    "residents_per_branch": lambda t: market.residents_per_branch(t.branches, STORE_CITY, city=t.city),
    "dwell_spend_regression": lambda t: regression.dwell_spend_regression(t.sales),
    "weekly_trend_regression": lambda t: regression.weekly_trend_regression(t.geo),
    "market_share": lambda t: market.market_share(t.sales, t.city, STORE_CITY),
}


def driver_tables(spark: SparkSession, sf_dir: str) -> RetailTables:
    """Canonical tables over the files of ``sf_dir`` as they are now: nothing is copied or cached."""
    return derive_from_driver_tables(spark, sf_dir)


def _on_driver_tables(op: Callable[[RetailTables], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(driver_tables(spark, sf_dir))

    return run


QUERIES: dict[str, Query] = {name: _on_driver_tables(op) for name, op in OPS.items()}

# Answers from stored summaries (sketches, bitmaps, merged parts), registered beside the direct ones.
SKETCHES: dict[str, Query] = {
    "fences_from_sketches": _on_driver_tables(lambda t: sketches.yearly_fence_check(t.sales)),
    "visitors_from_bitmaps": _on_driver_tables(lambda t: presence.all_answers(t.geo, t.sales)),
    "sessions_in_parts": lambda spark, sf_dir: incremental.sessions_in_parts(driver_tables(spark, sf_dir).geo, scratch_path(spark, "sessions")),
    "top_areas_from_sketches": _on_driver_tables(lambda t: sketches.top_areas(sketches.daily_area_sketches(t.geo))),
}
QUERIES.update(SKETCHES)

# Structured Streaming runs over the events files (availableNow, append mode). Output is what
# the stream emits: sessions and hours already closed by the 2-hour watermark.
STREAMING: dict[str, Query] = {
    "stream_sessions": lambda spark, sf_dir: live.sessions_from_stream(spark, sf_dir),
    "stream_hourly_visitors": lambda spark, sf_dir: live.hourly_visitors_from_stream(spark, sf_dir),
    "stream_visitor_estimates": lambda spark, sf_dir: live.visitor_estimates_from_stream(spark, sf_dir),
    "stream_complete_sessions": lambda spark, sf_dir: complete.complete_sessions_from_stream(spark, sf_dir),
}
QUERIES.update(STREAMING)


def kpi_marts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish every KPI as a mart, all in one version, and read them back: ``mart`` and its number of rows ``n_rows``."""
    store = marts.MartStore(spark, scratch_path(spark, "marts"))
    store.refresh(marts.build_kpis(driver_tables(spark, sf_dir)))
    return marts.published_sizes(store)


SINKS: dict[str, Query] = {"kpi_marts": kpi_marts}
QUERIES.update(SINKS)
