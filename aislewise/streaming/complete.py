"""Every session of a ping stream: those that the watermark closes, those still open, and what came late.

``session_window`` in append mode gives a session out when the watermark has passed it; sessions still
open when a finished source ends never come, and rows behind the watermark vanish uncounted. Here a
stateful processor (``transformWithState``) keeps a device's open sessions as a short list of (begin,
end, rows):

- a batch's rows of a device are cut into sessions by the gap rule and merged with the open ones, in
  whatever order they come;
- an event-time timer at the end of the first open session plus the gap gives closed sessions out;
- a row older than the watermark is not merged, as its session may have been given out already: it is
  counted, and the counts are written to the result as they arise. So every row is either in a session or
  counted as late, and a session is exactly what the batch operator finds in the rows that were not late;
- sessions open at the end are read from the state store, without closing the stream: a later run goes on
  from the same checkpoint and gives them out when they close.

State is a few numbers a device and open session. The watermark bounds a device's open sessions: those
whose end lies within delay plus gap. A hot device's rows stream through one task in Arrow batches and are
never held together.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from aislewise.streaming.live import _event_stream, as_event_time

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

_RESULT = "device_id string, kind string, begin_us long, end_us long, n_rows long"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def cut_sessions(times: np.ndarray, apart: int) -> list[tuple[int, int, int]]:
    """Sorted times as (begin, end, rows) of runs less than ``apart`` from one to the next."""
    if not len(times):
        return []
    cuts = np.flatnonzero(np.diff(times) >= apart) + 1
    begins, ends = np.r_[0, cuts], np.r_[cuts, len(times)]
    return list(zip(times[begins].tolist(), times[ends - 1].tolist(), (ends - begins).tolist(), strict=True))


def merge_sessions(parts: list[tuple[int, int, int]], apart: int) -> list[tuple[int, int, int]]:
    """Sessions less than ``apart`` from one another become one."""
    out: list[tuple[int, int, int]] = []
    for begin, end, n in sorted(parts):
        if out and begin - out[-1][1] < apart:
            last = out.pop()
            begin, end, n = last[0], max(last[1], end), last[2] + n
        out.append((begin, end, n))
    return out


class SessionProcessor(StatefulProcessor):
    """Open sessions of one device. ``apart``: microseconds from which two rows are in two sessions."""

    def __init__(self, apart: int):
        self.apart = apart

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "begin_us long, end_us long, n_rows long")

    def _keep(self, sessions: list[tuple[int, int, int]]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if sessions:
            self.open.put(sessions)
            self.handle.registerTimer(-(-(min(e for _, e, _ in sessions) + self.apart) // 1000))
        else:
            self.open.clear()

    def _held(self) -> list[tuple[int, int, int]]:
        return [tuple(map(int, s)) for s in self.open.get()] if self.open.exists() else []

    def _frame(self, key, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=["device_id", "kind", "begin_us", "end_us", "n_rows"]).astype({"begin_us": "Int64", "end_us": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, late, held = timerValues.getCurrentWatermarkInMs() * 1000, 0, self._held()
        for frame in rows:
            times = np.sort(frame["at_us"].to_numpy(np.int64))
            first = int(np.searchsorted(times, mark)) if mark > 0 else 0
            late += first
            held = merge_sessions(held + cut_sessions(times[first:], self.apart), self.apart)
        self._keep(held)
        yield from self._frame(key, [("late", None, None, late)] if late else [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, held = timerValues.getCurrentWatermarkInMs() * 1000, self._held()
        self._keep([s for s in held if s[1] + self.apart > mark])
        yield from self._frame(key, [("closed", *s) for s in held if s[1] + self.apart <= mark])

    def close(self) -> None:
        pass


def session_stream(geo: DataFrame, gap_minutes: int = 60, watermark: str = "2 hours") -> DataFrame:
    """Closed sessions and late rows of a stream of pings, for append mode: ``device_id``, ``kind`` (closed,
    late), ``begin_us``, ``end_us`` (microseconds since 1970, null for late rows) and ``n_rows``.
    Rows without a timestamp belong to no session and are left out, as by ``stream_sessions``."""
    events = as_event_time(geo).where("event_time IS NOT NULL").withWatermark("event_time", watermark)
    # As a number the time is a plain column: Spark's own filter of late rows does not see it, so they
    # reach the processor and are counted.
    rows = events.select("device_id", F.unix_micros("event_time").alias("at_us"))
    apart = (gap_minutes + 1) * 60_000_000
    return rows.groupBy("device_id").transformWithStateInPandas(SessionProcessor(apart), outputStructType=_RESULT, outputMode="Append", timeMode="EventTime")


class SessionRun:
    """A stream of sessions over a folder that keeps its state: run it again when more pings are there."""

    def __init__(self, spark: SparkSession, folder: str, gap_minutes: int = 60, watermark: str = "2 hours"):
        self.spark, self.gap_minutes, self.watermark = spark, gap_minutes, watermark
        self.out, self.state = os.path.join(folder, "out"), os.path.join(folder, "state")

    def run(self, geo: DataFrame) -> SessionRun:
        """Process all that is available; Spark's state store for ``transformWithState`` is RocksDB."""
        before = self.spark.conf.get(_PROVIDER)
        self.spark.conf.set(_PROVIDER, _ROCKSDB)
        try:
            stream = session_stream(geo, self.gap_minutes, self.watermark).writeStream.format("parquet").outputMode("append")
            query = stream.option("path", self.out).option("checkpointLocation", self.state).trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            self.spark.conf.set(_PROVIDER, before)
        return self

    def _written(self) -> DataFrame:
        try:
            return self.spark.read.schema(_RESULT).parquet(self.out)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _RESULT)  # no batch ran, so there is no folder

    def _has_state(self) -> bool:
        """Whether a batch has been committed; before the first there is no state to read."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.state, "commits"))
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files.exists(place) and any(not f.getPath().getName().startswith(".") for f in files.listStatus(place))

    def sessions(self) -> DataFrame:
        """All sessions so far: ``device_id``, ``session_begin``, ``session_end``, ``n_rows`` and ``closed``,
        false for those that later rows may still join."""
        done = self._written().where("kind = 'closed'").select("device_id", "begin_us", "end_us", "n_rows", F.lit(True).alias("closed"))
        if self._has_state():
            state = self.spark.read.format("statestore").option("path", self.state).option("stateVarName", "open").load()
            done = done.unionByName(state.select("key.device_id", "list_element.*", F.lit(False).alias("closed")))
        return done.select("device_id", F.timestamp_micros("begin_us").alias("session_begin"), F.timestamp_micros("end_us").alias("session_end"), "n_rows", "closed")

    def late_rows(self) -> DataFrame:
        """Rows behind the watermark, per device: ``device_id`` and ``n_late``."""
        return self._written().where("kind = 'late'").groupBy("device_id").agg(F.sum("n_rows").alias("n_late"))


def complete_sessions_from_stream(spark: SparkSession, sf_dir: str, gap_minutes: int = 60, watermark: str = "2 hours") -> DataFrame:
    """Every session of the event files, run as a stream over all that is there, with ``n_late``, the device's
    rows that came too late for a session."""
    from aislewise.session import scratch_path
    from aislewise.sources.tables import geolocation_from_events

    run = SessionRun(spark, scratch_path(spark, "streams-complete"), gap_minutes, watermark)
    run.run(geolocation_from_events(_event_stream(spark, sf_dir)))
    late = run.late_rows().withColumnRenamed("device_id", "late_device")
    rows = run.sessions().join(late, F.col("device_id").eqNullSafe(F.col("late_device")), "left")
    wall = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_begin", "session_end")]
    return rows.select("device_id", *wall, "n_rows", "closed", F.coalesce("n_late", F.lit(0).cast("long")).alias("n_late"))
