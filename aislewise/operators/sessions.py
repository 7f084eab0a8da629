"""Gap-based sessionization that stays parallel when one key is very hot.

A new session starts at the first row of a key, or when the whole minutes since
the previous row of the same key exceed ``gap_minutes``; rows with equal
timestamps always share a session.

The textbook form is ``lag`` plus a running ``sum`` over ``PARTITION BY key
ORDER BY ts``. That puts every row of a key into one task: a device that sends
a third of all pings would be sorted by a single task. Here it is done in two
levels, with no join back to the rows:

1. two rows in one time bucket of ``gap_minutes + 1`` minutes are less than that
   apart, so their whole minutes never exceed the gap: all rows of a key in one
   bucket belong to one session. They reduce to (begin, end, row count) by an
   ordinary aggregate, combined map-side; however hot a key is, and NULL is one,
   no task sorts or receives its rows;
2. the buckets of a key are sessionized by the rule, with the ``end`` of the
   bucket before and the ``begin`` of the next. A key has at most (time span /
   bucket) of them, so this window is bounded by time, not by row count.

Rows without a timestamp have no previous row to be near to: each of them is a
visit of its own in ``session_counts``. ``session_summary`` reports those of a key
as one row without times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislewise.functions.timeparts import whole_minutes


def _time_bucket(ts: Column, minutes_wide: int) -> Column:
    """Monotone integer bucket of a timestamp_ntz; no time-zone arithmetic involved."""
    minutes = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)
    return F.floor(minutes / F.lit(minutes_wide)).cast("long")


def bucket_rows(df: DataFrame, keys: Sequence[str], ts: str, gap_minutes: int) -> DataFrame:
    """One row per key and time bucket: ``keys``, ``__b``, ``__begin``, ``__end``, ``__n``. Rows of two parts of the
    data merge by taking the least begin, the greatest end and the sum (``merged_buckets``)."""
    rows = df.select(*keys, F.col(ts).alias("__t"))
    return rows.groupBy(*keys, _time_bucket(F.col("__t"), gap_minutes + 1).alias("__b")).agg(
        F.min("__t").alias("__begin"), F.max("__t").alias("__end"), F.count(F.lit(1)).alias("__n")
    )


def merged_buckets(buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bucket rows of several parts of the data as those of the whole."""
    return buckets.groupBy(*keys, "__b").agg(F.min("__begin").alias("__begin"), F.max("__end").alias("__end"), F.sum("__n").alias("__n"))


def _numbered(buckets: DataFrame, keys: Sequence[str], gap_minutes: int) -> DataFrame:
    """Bucket rows with ``__start`` (1 where a session begins) and ``__sid``."""
    w = Window.partitionBy(*keys).orderBy("__begin")  # NULL, if any, comes first and is never near
    prev_end = F.lag("__end").over(w)
    starts = (prev_end.isNull() | (whole_minutes(prev_end, F.col("__begin")) > F.lit(gap_minutes))).cast("int")
    return buckets.withColumn("__start", starts).withColumn("__sid", F.sum("__start").over(w).cast("long"))


def session_counts(df: DataFrame, keys: Sequence[str], ts: str = "timestamp", gap_minutes: int = 60) -> DataFrame:
    """One row per key: ``keys`` and ``n_sessions``. Counted where the buckets already sit
    partitioned by key, so no further shuffle is needed."""
    local = _numbered(bucket_rows(df, keys, ts, gap_minutes), keys, gap_minutes)
    sessions = F.when(F.col("__begin").isNull(), F.col("__n")).otherwise(F.col("__start"))
    return local.groupBy(*keys).agg(F.sum(sessions).alias("n_sessions"))


def session_summary(df: DataFrame, keys: Sequence[str], ts: str = "timestamp", gap_minutes: int = 60) -> DataFrame:
    """One row per session: ``keys``, session_begin, session_end, n_rows.

    Rows whose key columns are NULL form one key, as in ``PARTITION BY``.
    """
    return sessions_of_buckets(bucket_rows(df, keys, ts, gap_minutes), keys, gap_minutes)


def sessions_of_buckets(buckets: DataFrame, keys: Sequence[str], gap_minutes: int = 60) -> DataFrame:
    """``session_summary`` from bucket rows (of ``bucket_rows`` with the same gap, merged)."""
    return _numbered(buckets, keys, gap_minutes).groupBy(*keys, "__sid").agg(
        F.min("__begin").alias("session_begin"), F.max("__end").alias("session_end"), F.sum("__n").alias("n_rows")
    ).drop("__sid")
