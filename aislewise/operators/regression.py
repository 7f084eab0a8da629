"""Simple linear regressions over the regression input queries.

The original shows only the input rows (dwell versus spend, week versus visitors) and reports
an R^2; the fit itself is here: ordinary least squares with Spark's ``regr_*`` aggregates,
which are algebraic and combine map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.functions.numeric import round_half_up
from aislewise.operators.footfall import weekly_visitors
from aislewise.operators.sales import dwell_vs_spend


def linear_fit(df: DataFrame, y: str, x: str, digits: int = 6) -> DataFrame:
    """One row: slope, intercept, r2 (rounded to ``digits``) and the number of (x, y) pairs."""
    Y, X = F.col(y), F.col(x)
    return df.agg(
        round_half_up(F.regr_slope(Y, X), digits).alias("slope"),
        round_half_up(F.regr_intercept(Y, X), digits).alias("intercept"),
        round_half_up(F.regr_r2(Y, X), digits).alias("r2"),
        F.regr_count(Y, X).alias("n"),
    )


def dwell_spend_regression(sales: DataFrame) -> DataFrame:
    return linear_fit(dwell_vs_spend(sales, ordered=False), "purchase_amount", "dwell_minutes")


def weekly_trend_regression(geo: DataFrame) -> DataFrame:
    return linear_fit(weekly_visitors(geo, ordered=False), "unique_visitors_count", "week_number")
