"""Invariants from the test plan: shares sum to 100, sessions never outnumber pings, the staffing
gap is actual minus required, staff and visitor roles are disjoint, approximate options agree."""

import pytest
from pyspark.sql import functions as F

from aislewise.operators import entities, operations, sales
from aislewise.operators.sessions import session_summary
from aislewise.sources.schemas import STAFF_ROLES, VISITOR_ROLES


def test_shares_sum_to_100(tables):
    assert sales.payment_mix(tables.sales).agg(F.sum("percentage")).first()[0] == pytest.approx(100.0)
    assert sales.daily_visit_distribution(tables.sales).agg(F.sum("percentage")).first()[0] == pytest.approx(100.0, abs=0.05)
    per_cat = sales.basket_mix_peak_offpeak(tables.sales).groupBy("time_category").agg(F.sum("share_pct").alias("s")).collect()
    assert all(r["s"] == pytest.approx(100.0, abs=0.05) for r in per_cat)
    assert sales.whale_demographics(tables.sales, tables.geo).agg(F.sum("share_of_whales_pct")).first()[0] == pytest.approx(100.0, abs=0.2)


def test_sessions_never_exceed_pings(tables):
    s = session_summary(tables.geo, ["device_id"], "timestamp", 60)
    per_device = s.groupBy("device_id").agg(F.count("*").alias("sessions"), F.sum("n_rows").alias("pings"))
    pings = tables.geo.groupBy("device_id").agg(F.count("*").alias("all_pings"))
    j = per_device.join(pings, "device_id").collect()
    assert all(r["sessions"] <= r["pings"] == r["all_pings"] for r in j)


def test_staffing_gap_is_actual_minus_required(tables):
    rows = operations.staffing_gap(tables.geo, tables.sales).collect()
    assert rows and all(r["staffing_gap"] == r["actual_registers_open"] - r["optimal_registers_needed"] for r in rows)


def test_staff_and_visitor_roles_disjoint(tables):
    roles = {r[0]: r[1] for r in entities.classify_entities(tables.geo, tables.sales).collect() if r[1] != "no_phone"}
    staff = {d for d, r in roles.items() if r in STAFF_ROLES}
    visitors = {d for d, r in roles.items() if r in VISITOR_ROLES}
    assert staff and visitors and not (staff & visitors)
    assert staff | visitors == set(roles)


def test_approximate_options_close_to_exact(tables):
    exact = {r["role"]: r for r in entities.signal_accuracy_by_role(tables.geo).collect()}
    approx = {r["role"]: r for r in entities.signal_accuracy_by_role(tables.geo, exact=False).collect()}
    assert exact.keys() == approx.keys()
    for role, r in exact.items():
        assert r["total_signals"] == approx[role]["total_signals"]
        assert r["outlier_ratio"] == approx[role]["outlier_ratio"]
    f_exact = sales.iqr_fence(tables.sales).first()
    f_approx = sales.iqr_fence(tables.sales, exact=False).first()
    assert f_approx["upper_fence"] == pytest.approx(f_exact["upper_fence"], rel=0.01)


def test_trim_all_whitespace(spark):
    from aislewise.operators.market import estimated_households, market_saturation

    city = spark.createDataFrame([("\tX ", 50000), (" Y ", 40000)], "city_name string, total_population bigint")
    branches = spark.createDataFrame([("1", "X"), ("2", "Y\t")], "branch_id string, city string")
    assert estimated_households(city, "X", all_whitespace=False).count() == 0  # blanks only: the tab stays
    assert estimated_households(city, "X").count() == 1
    got = {r["city_name"] for r in market_saturation(city, branches).collect()}
    assert got == {"X", "Y"}
