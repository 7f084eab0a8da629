"""Structured Streaming versions of sessionization and hourly footfall.

Both functions take a *streaming* DataFrame of geolocation pings and return a
streaming DataFrame for ``writeStream`` in append mode. They also accept a
static DataFrame, which gives the batch answer for the same definition.

Event time must be TIMESTAMP (with time zone): watermarks reject
``timestamp_ntz``. ``as_event_time`` casts the canonical NTZ column; run the
session with a fixed-offset zone (UTC) so the cast is monotone.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewise.session import scratch_path


def as_event_time(geo: DataFrame, ts: str = "timestamp") -> DataFrame:
    return geo.withColumn("event_time", F.col(ts).cast("timestamp"))


def session_gap_text(gap_minutes: int) -> str:
    """Session-window gap equivalent to "new session when whole minutes since the previous ping
    exceed ``gap_minutes``": pings stay together while less than gap+1 minutes apart, and a
    session window merges the next event when it is at most ``gap`` after the last one."""
    return f"{(gap_minutes + 1) * 60 - 0.000001:.6f} seconds"


def stream_sessions(geo: DataFrame, gap_minutes: int = 60, watermark: str = "2 hours") -> DataFrame:
    """Device sessions from a ping stream. A session is emitted once the watermark passes its end,
    so sessions still open when the stream stops are not emitted in append mode."""
    events = as_event_time(geo).select("device_id", "event_time").withWatermark("event_time", watermark)
    return (
        events.groupBy("device_id", F.session_window("event_time", session_gap_text(gap_minutes)).alias("w"))
        .agg(
            F.min("event_time").alias("session_begin"),
            F.max("event_time").alias("session_end"),
            F.count(F.lit(1)).alias("n_rows"),
        )
        .select("device_id", "session_begin", "session_end", "n_rows")
    )


def stream_hourly_visitors(geo: DataFrame, roles: tuple[str, ...] | None = None, watermark: str = "2 hours") -> DataFrame:
    """Distinct devices per one-hour event-time window, exact: (window, device) pairs are
    de-duplicated under the watermark first, then counted."""
    events = as_event_time(geo)
    if roles is not None:
        events = events.where(F.col("role").isin(*roles))
    pairs = (
        events.withWatermark("event_time", watermark)
        .select(F.window("event_time", "1 hour").alias("w"), "device_id")
        .dropDuplicates(["w", "device_id"])
    )
    return pairs.groupBy("w").agg(F.count("device_id").alias("unique_visitors")).select(
        F.col("w.start").alias("hour_start"), F.col("w.end").alias("hour_end"), "unique_visitors"
    )


def run_available_now(stream: DataFrame, name: str, spark: SparkSession) -> DataFrame:
    """Run ``stream`` over everything available, append to Parquet under the checkpoint folder,
    wait for it, and return the written result as a batch DataFrame (empty if nothing came)."""
    base = scratch_path(spark, f"streams-{name}")
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", os.path.join(base, "out"))
        .option("checkpointLocation", os.path.join(base, "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    try:
        return spark.read.schema(stream.schema).parquet(os.path.join(base, "out"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], stream.schema)  # no batch ran, so there is no folder


def _event_stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """A file stream over one of the driver's Parquet tables, a folder of part files or a single file
    (every file present is one batch). A stream reads folders only, so a single file is picked by
    its name from the folder it stands in."""
    path = os.path.join(sf_dir, f"{table}.parquet")
    rows = spark.read.parquet(path)
    reader = spark.readStream.schema(rows.schema)
    single = all(f.rstrip("/").endswith(f"/{table}.parquet") for f in rows.inputFiles())
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir) if single else reader.parquet(path)


def _wall_clock(df: DataFrame, *cols: str) -> DataFrame:
    """Event-time columns back to timestamp_ntz, like the canonical tables."""
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def sessions_from_stream(spark: SparkSession, sf_dir: str, gap_minutes: int = 60, watermark: str = "2 hours") -> DataFrame:
    from aislewise.sources.tables import geolocation_from_events

    stream = stream_sessions(geolocation_from_events(_event_stream(spark, sf_dir)), gap_minutes, watermark)
    return _wall_clock(run_available_now(stream, "sessions", spark), "session_begin", "session_end")


def hourly_visitors_from_stream(spark: SparkSession, sf_dir: str, watermark: str = "2 hours") -> DataFrame:
    from aislewise.sources.tables import geolocation_from_events

    stream = stream_hourly_visitors(geolocation_from_events(_event_stream(spark, sf_dir)), None, watermark)
    return _wall_clock(run_available_now(stream, "hourly", spark), "hour_start", "hour_end")


def visitor_estimates_from_stream(spark: SparkSession, sf_dir: str, watermark: str = "2 hours") -> DataFrame:
    """Distinct devices per hour, date and week, estimated from the hourly sketches that a stream over the event
    files gives out: the hours that the watermark has closed. The pings are read once, and their state
    is one sketch an open hour."""
    from aislewise.operators.sketches import hourly_visitor_sketches, visitor_estimates
    from aislewise.sources.tables import geolocation_from_events

    events = as_event_time(geolocation_from_events(_event_stream(spark, sf_dir))).withWatermark("event_time", watermark)
    hourly = run_available_now(hourly_visitor_sketches(events, time="event_time"), "sketches", spark)
    return visitor_estimates(hourly)
