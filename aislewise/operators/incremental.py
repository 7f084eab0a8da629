"""Sessions kept up to date: a new part of the data recomputes only the keys it has rows of.

Two tables are stored: bucket rows (a key's rows in one time bucket, see ``sessions``) and the sessions made
of them. A new part is reduced to bucket rows; stored bucket rows of the same keys are merged with them,
and those keys' sessions are made again. Old rows may lie before, between or after: a new row that joins two old
sessions makes them one. All other keys' rows are carried over as they are. Neither the old facts nor the
sessions of other keys are read again.

Both tables are published together (``MartStore``): a reader never sees sessions that do not belong to the bucket
rows, and a failed merge changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewise.operators.sessions import bucket_rows, merged_buckets, sessions_of_buckets
from aislewise.session import materialize
from aislewise.sources.marts import MartStore


class SessionStore:
    """Sessions of ``keys`` in a folder, fed part by part. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], ts: str = "timestamp", gap_minutes: int = 60):
        self.store, self.keys, self.ts, self.gap_minutes = MartStore(spark, path), list(keys), ts, gap_minutes

    def _of(self, rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        """Rows whose key, missing parts included, is among ``keys`` (or is not)."""
        other = keys.toDF(*[f"__k{i}" for i in range(len(self.keys))])
        same = [rows[k].eqNullSafe(other[f"__k{i}"]) for i, k in enumerate(self.keys)]
        condition = same[0]
        for c in same[1:]:
            condition = condition & c
        return rows.join(other, condition, how)

    def add(self, rows: DataFrame) -> int:
        """Merge new rows; returns the number of keys that were made again."""
        new = materialize(bucket_rows(rows, self.keys, self.ts, self.gap_minutes))
        touched = materialize(new.select(*self.keys).distinct())
        if self.store.version() is None:
            buckets, rest, done = new, None, None
        else:
            old = self.store.read("buckets")
            buckets = materialize(merged_buckets(self._of(old, touched, "left_semi").unionByName(new), self.keys))
            rest, done = self._of(old, touched, "left_anti"), self._of(self.store.read("sessions"), touched, "left_anti")
        sessions = sessions_of_buckets(buckets, self.keys, self.gap_minutes)
        self.store.refresh({"buckets": buckets if rest is None else rest.unionByName(buckets), "sessions": sessions if done is None else done.unionByName(sessions)})
        self.store.clean()
        return touched.count()

    def sessions(self) -> DataFrame:
        """As ``session_summary`` of all rows added so far."""
        return self.store.read("sessions")

    def counts(self) -> DataFrame:
        """As ``session_counts`` of all rows added so far: a row without a time is a session of its own."""
        each = F.when(F.col("session_begin").isNull(), F.col("n_rows")).otherwise(F.lit(1))
        return self.sessions().groupBy(*self.keys).agg(F.sum(each).cast("long").alias("n_sessions"))


def sessions_in_parts(geo: DataFrame, path: str, parts: int = 3, gap_minutes: int = 60) -> DataFrame:
    """Device sessions of all pings, merged part by part in order of date; what comes out is what one
    run over everything gives."""
    store = SessionStore(geo.sparkSession, path, ["device_id"], "timestamp", gap_minutes)
    known = geo.where("timestamp IS NOT NULL")
    first, last = known.agg(F.min(F.to_date("timestamp")), F.max(F.to_date("timestamp"))).first()
    if first is None:
        return sessions_of_buckets(bucket_rows(known, ["device_id"], "timestamp", gap_minutes), ["device_id"], gap_minutes)
    part = F.floor(F.datediff(F.to_date("timestamp"), F.lit(first)) * F.lit(parts) / F.lit((last - first).days + 1))
    for i in range(parts):
        store.add(known.where(part == i))
    return store.sessions()
