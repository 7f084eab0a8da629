"""Results must not depend on the session time zone or on ANSI mode (the caller's session
may set either): timestamps are timestamp_ntz and every calendar helper is zone-free."""

import pytest

import __spark_entry__ as entry
from sf_dirs import SF_CHECK
from tools.oracle_check import duck, rows_of

NAMES = ["traffic_heatmap", "classify_entities", "capture_rate", "staffing_gap", "weekly_visitors", "missed_deliveries"]


@pytest.mark.parametrize("conf,value", [("spark.sql.session.timeZone", "America/New_York"), ("spark.sql.ansi.enabled", "false")])
def test_results_independent_of_session_settings(spark, conf, value):
    old = spark.conf.get(conf)
    spark.conf.set(conf, value)
    try:
        con = duck(SF_CHECK)
        for name in NAMES:
            df = entry.queries()[name](spark, SF_CHECK)
            rel = con.execute(entry.oracle_sql()[name])
            cols = [c[0] for c in rel.description]
            assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, rel.fetchall()), name
    finally:
        spark.conf.set(conf, old)
