"""Numeric helpers that give the same answer on every engine and every run.

Money is summed as DECIMAL with nine digits after the point (and 19 before): exact for
amounts of up to nine decimals, whatever their currency's smallest unit, and independent of the
order in which partitions are combined. Rounding goes through a DECIMAL cast so a half is
rounded away from zero on the decimal value, not on the nearest binary double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(28,9)"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round_half_up(col: str | Column, digits: int = 0) -> Column:
    """ROUND(x, digits), half away from zero, returned as DOUBLE."""
    return F.round(_c(col).cast("decimal(38,9)"), digits).cast("double")


def money_sum(col: str | Column) -> Column:
    """Exact SUM of a money column, as DOUBLE."""
    return F.sum(_c(col).cast(MONEY)).cast("double")


def money_avg(col: str | Column) -> Column:
    """AVG of a money column: exact decimal sum divided by the non-null count."""
    return F.try_divide(money_sum(col), F.count(_c(col)))


def share_pct(part: str | Column, whole: str | Column) -> Column:
    """part * 100.0 / whole as DOUBLE; NULL when ``whole`` is 0."""
    return F.try_divide(_c(part).cast("double") * F.lit(100.0), _c(whole).cast("double"))


def ratio(num: str | Column, den: str | Column) -> Column:
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))
