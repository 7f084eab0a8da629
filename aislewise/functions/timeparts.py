"""Calendar expressions with the warehouse semantics the queries rely on.

All inputs are ``timestamp_ntz`` (or ``date``) columns, so hour and weekday
never depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def weekday_name(ts: str | Column) -> Column:
    """Full English weekday name, e.g. ``Sunday``."""
    return F.date_format(_c(ts), "EEEE")


def weekday_name_of(index: str | Column) -> Column:
    """The name of a weekday index (1 = Sunday). For use after an aggregate, on its few rows."""
    return F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), _c(index) - F.lit(1)), "EEEE")


def weekday_index(ts: str | Column) -> Column:
    """1 = Sunday ... 7 = Saturday."""
    return F.dayofweek(_c(ts))


def hour_of_day(ts: str | Column) -> Column:
    return F.hour(_c(ts))


def whole_minutes(start: str | Column, end: str | Column) -> Column:
    """Whole elapsed minutes from ``start`` to ``end`` (truncated toward zero)."""
    return F.timestamp_diff("MINUTE", _c(start), _c(end))


def sunday_week(ts: str | Column) -> Column:
    """Week of year 0..53, weeks start on Sunday, days before the first Sunday are week 0."""
    d = F.to_date(_c(ts))
    return F.floor((F.dayofyear(d) + F.lit(7) - F.dayofweek(d)) / F.lit(7)).cast("int")


def sunday_week_start(ts: str | Column) -> Column:
    """The Sunday on or before the date."""
    d = F.to_date(_c(ts))
    return F.date_sub(d, F.dayofweek(d) - F.lit(1))
