"""Bucketed fact tables: the same answers, and no shuffle by device or customer."""

import re

import pytest

from aislewise.operators import entities, operations
from aislewise.operators.sessions import session_summary
from aislewise.sources.bucketed import BucketedTables, SkewedBuckets, skew, write_bucketed
from aislewise.sources.tables import RetailTables


@pytest.fixture(scope="module")
def bucketed(spark, tables):
    names = write_bucketed(tables, "bucketed_", buckets=8)
    yield BucketedTables(spark, names, tables)
    for name in names.values():
        spark.sql(f"DROP TABLE {name}")


def by_key(df):
    """Hash shuffles by device or customer in the plan before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    return re.findall(r"Exchange hashpartitioning\((?:device_id|customer_id|final_user_id|__key)[^)]*\)", plan)


def queries(t, **more):
    return {
        "classify_entities": entities.classify_entities(t.geo, t.sales, materialize_profiles=False, **more),
        "capture_rate": operations.capture_rate(t.geo),
        "staffing_gap": operations.staffing_gap(t.geo, t.sales),
        "sessions": session_summary(t.geo, ["device_id"]),
    }


def test_no_shuffle_by_key_and_equal_answers(spark, tables, bucketed):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # joins by key must come from the layout
    try:
        with_buckets, plain = queries(bucketed, identified=bucketed.identified), queries(tables)
        for name, df in with_buckets.items():
            assert by_key(df) == [], name
            assert sorted(map(str, df.collect())) == sorted(map(str, plain[name].collect())), name
        joined = with_buckets["classify_entities"]._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in joined
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert bucketed.sales.count() == tables.sales.count() and bucketed.geo.count() == tables.geo.count()


def test_a_hot_device_is_refused(spark, tables):
    hot = spark.range(30_000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) AS device_id")
    geo = hot.selectExpr("device_id", "timestamp_ntz'2024-01-01 00:00:00' AS timestamp", "'PARKING' AS area", "1.0D AS accuracy_m", "CAST(NULL AS STRING) AS role")
    assert skew(geo, "device_id", 64) > 20 and skew(geo.limit(0), "device_id", 64) == 0
    with pytest.raises(SkewedBuckets):
        write_bucketed(RetailTables(geo, tables.sales, tables.city, tables.branches), "refused_", buckets=64)
    assert not any(t.name.startswith("refused_") for t in spark.catalog.listTables())
