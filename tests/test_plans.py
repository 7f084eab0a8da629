"""Physical-plan properties the operators are designed for, over all executions of a query."""

import json

import pytest

from aislewise.plans.registry import QUERIES
from sf_dirs import SF_CHECK
from tools.executed_plans import ExecutedPlans, exchanges, scans


@pytest.fixture
def nodes_of(spark, event_folder):
    plans = ExecutedPlans(spark, event_folder)

    def run(name):
        plans.mark()
        QUERIES[name](spark, SF_CHECK).collect()
        return plans.nodes()

    return run


def below(node, found=None):
    found = [] if found is None else found
    for child in node["children"]:
        found.append(child)
        below(child, found)
    return found


def test_filters_reach_the_scan(nodes_of):
    pushed = json.dumps([n["metadata"] for n in scans(nodes_of("capture_rate"), "events.parquet")])
    assert "ReadSchema" in pushed and "event_id" not in pushed, pushed  # pruned to what device and time need


def test_column_pruning(nodes_of):
    found = scans(nodes_of("signal_accuracy"), "events.parquet")
    assert found and all(n["metadata"]["ReadSchema"] == "struct<value:double>" for n in found), found


def test_sessions_aggregate_before_the_window(nodes_of):
    """Rows are combined map-side into time buckets, which are shuffled by (key, bucket) and by key; the
    window stands above both, and nothing is joined back."""
    for name, shuffles in (("capture_rate", 2), ("daily_visit_distribution", 3)):
        nodes = nodes_of(name)
        assert len(exchanges(nodes, "hashpartitioning")) == shuffles, name
        assert not [n for n in nodes if "Join" in n["nodeName"]], name
        windows = [n for n in nodes if n["nodeName"] == "Window" and "lag(" in n["simpleString"]]
        assert windows, name
        for w in windows:
            assert len(exchanges(below(w), "hashpartitioning")) == 2, name
            assert [n for n in below(w) if "HashAggregate" in n["nodeName"]], name


@pytest.mark.parametrize("name", ["classify_entities", "visitor_roster"])
def test_pings_are_read_once(nodes_of, name):
    """Over all executions, also those that run while the query is built."""
    assert len(scans(nodes_of(name), "events.parquet")) == 1


@pytest.mark.parametrize("name,reads", [("ticket_outliers", 1), ("whale_demographics", 2)])
def test_tickets_are_read_once_for_the_fence(nodes_of, name, reads):
    assert len(scans(nodes_of(name), "orders.parquet")) == reads


def test_heatmap_expands_distinct_rows_only(nodes_of):
    expands = [n for n in nodes_of("traffic_heatmap") if n["nodeName"] == "Expand"]
    assert expands
    for e in expands:  # what is expanded has been made distinct by (device, date, hour)
        assert [n for n in below(e) if n["nodeName"] == "HashAggregate" and "count(1)" in n["simpleString"]]


def test_missed_deliveries_filters_weekdays_first(nodes_of):
    nodes = nodes_of("missed_deliveries")
    (scan,) = scans(nodes, "events.parquet")
    partial = [n for n in nodes if n["nodeName"] == "HashAggregate" and "partial_max" in n["simpleString"]]
    assert partial and all(any(x["nodeName"] == "Filter" and "dayofweek" in x["simpleString"] for x in below(p)) for p in partial)


def test_only_one_row_sides_are_nested_loop_joined(nodes_of):
    """Cross joins only ever meet a broadcast one-row side (fence, totals): no cartesian product."""
    for name in ("ticket_outliers", "whale_demographics", "market_share", "classify_entities"):
        names = {n["nodeName"] for n in nodes_of(name)}
        assert "CartesianProduct" not in names
        assert "BroadcastNestedLoopJoin" in names


def test_regressions_do_not_sort(nodes_of):
    """The presentation ORDER BY of the input rows must not survive under the fit's aggregate."""
    for name in ("dwell_spend_regression", "weekly_trend_regression"):
        assert not exchanges(nodes_of(name), "rangepartitioning"), name
