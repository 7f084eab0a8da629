"""KPI marts sink and the streaming operators on a static input."""

import os
import tempfile
import time

from pyspark.sql import functions as F

from aislewise.operators.sessions import session_summary
from aislewise.sources.marts import build_kpis, read_kpi_mart, write_kpi_marts
from aislewise.streaming.live import session_gap_text, stream_hourly_visitors, stream_sessions


def test_write_and_read_marts(spark, tables):
    out = tempfile.mkdtemp(prefix="marts-", dir=os.environ.get("TMPDIR", "/tmp"))
    results = build_kpis(tables, names={"traffic_heatmap", "payment_mix", "staffing_gap"})
    written = write_kpi_marts(results, out)
    assert len(written) == 3
    for name, df in results.items():
        back = read_kpi_mart(spark, out, name)
        assert sorted(back.columns) == sorted(df.columns)
        assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0


def test_session_gap_text():
    assert session_gap_text(60) == "3659.999999 seconds"
    assert session_gap_text(20) == "1259.999999 seconds"


def test_static_session_window_equals_sessionize(spark, tables):
    """On a static frame (no watermark effect) the session-window form equals the gap rule."""
    windowed = stream_sessions(tables.geo).select(
        "device_id", F.col("session_begin").cast("timestamp_ntz").alias("b"), "n_rows"
    )
    gap_rule = session_summary(tables.geo, ["device_id"], "timestamp", 60).select(
        "device_id", F.col("session_begin").alias("b"), "n_rows"
    )
    assert windowed.count() == gap_rule.count()
    assert windowed.exceptAll(gap_rule).count() == 0


def test_static_hourly_visitors(spark, tables):
    got = stream_hourly_visitors(tables.geo).select(F.col("hour_start").cast("timestamp_ntz").alias("h"), "unique_visitors")
    expected = tables.geo.groupBy(F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("h")).agg(
        F.countDistinct("device_id").alias("unique_visitors")
    )
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0


def test_sql_views(spark, tables):
    from aislewise.sources.marts import register_views

    names = register_views(spark, tables)
    assert "kpi_staffing_gap" in names and len(names) == 31
    n = spark.sql("SELECT count(*) FROM kpi_traffic_heatmap").first()[0]
    assert n == spark.sql("SELECT count(DISTINCT dayofweek(timestamp), hour(timestamp)) FROM geolocation").first()[0]


def test_command_line(spark):
    import os
    import tempfile

    from aislewise.__main__ import main

    out = tempfile.mkdtemp(prefix="cli-")
    main(["--driver-tables", "/root/testdata/sf0.001", "--out", out, "--only", "payment_mix,capture_rate"])
    assert sorted(os.listdir(out)) == ["capture_rate", "payment_mix"]
    assert spark.read.parquet(os.path.join(out, "payment_mix")).count() > 0


def test_streams_read_folder_tables(spark):
    """A table stored as a folder of part files gives what the single file gives; an empty one nothing."""
    from aislewise.streaming.live import hourly_visitors_from_stream, sessions_from_stream

    base = tempfile.mkdtemp(prefix="folder-")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(os.path.join(base, "full", "events.parquet"))
    events.limit(0).write.parquet(os.path.join(base, "empty", "events.parquet"))
    for run in (sessions_from_stream, hourly_visitors_from_stream):
        single, folder = run(spark, "/root/testdata/sf0.001"), run(spark, os.path.join(base, "full"))
        assert single.count() == folder.count() > 0
        assert single.exceptAll(folder).count() == 0
        assert run(spark, os.path.join(base, "empty")).count() == 0


def test_mart_sizes(spark, tables):
    from aislewise.session import scratch_path
    from aislewise.sources.marts import mart_sizes

    out = scratch_path(spark, "marts")
    results = build_kpis(tables, names={"payment_mix", "devices_with_role"})
    write_kpi_marts(results, out)
    assert {r["mart"]: r["n_rows"] for r in mart_sizes(spark, out, sorted(results)).collect()} == {n: df.count() for n, df in results.items()}


_WITHOUT_SETTING = """
import glob, os, sys
sys.path.insert(0, sys.argv[1])
from aislewise.session import checkpoint_dir, local_session
spark = local_session(cores="2")
assert not spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
from aislewise.plans.registry import QUERIES
assert QUERIES["classify_entities"](spark, "/root/testdata/sf0.001").count() > 0
place = checkpoint_dir(spark).removeprefix("file:")
assert place == checkpoint_dir(spark).removeprefix("file:") and glob.glob(place + "/materialized/*")
print("PLACE", place)
spark.stop()
"""


def test_without_a_checkpoint_setting(tmp_path):
    """A local session without ``spark.checkpoint.dir`` makes a scratch folder, and what operators wrote
    there is gone when the session has ended."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    env.pop("PYSPARK_SUBMIT_ARGS", None)
    run = subprocess.run([sys.executable, "-c", _WITHOUT_SETTING, root], env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    place = os.path.join(run.stdout.split("PLACE ")[1].strip(), "materialized")
    for _ in range(60):  # the JVM ends a little after Python
        if not os.path.isdir(place) or not os.listdir(place):
            break
        time.sleep(1)
    else:
        raise AssertionError(os.listdir(place))
