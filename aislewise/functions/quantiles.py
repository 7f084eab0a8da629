"""Exact discrete percentiles without funnelling the column through one task.

``PERCENTILE_DISC(p)`` is the smallest value whose cumulative share of rows is
at least ``p``, i.e. the value of 1-based rank ``max(1, ceil(n * p))``.

Spark's own ``percentile_disc`` keeps every distinct value of the column in
one aggregation buffer and merges them in a single final task. Here:

1. rows collapse to (value, multiplicity) with a partially aggregated group-by, which is written once:
   all further steps, and the caller's, read that table;
2. one aggregate gives the number of rows, of distinct values, and ``pivots - 1`` cut points by
   ``percentile_approx`` over the distinct values;
3. as long as the interval that holds a wanted rank has more than ``max_sorted`` distinct values, a round cuts
   it into ``pivots`` buckets at the cut points (a binary search written as a nested CASE, compiled by whole-stage
   codegen), counts each bucket's rows and values, and takes the new cut points from the bucket with the rank.
   Only numbers of at most ``pivots`` buckets come to the driver;
4. the interval's values, at most ``max_sorted`` of them, are sorted in one task.

So no task sorts more than ``max_sorted`` values, however many there are. The cut points decide how many
rounds it takes, never the answer.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _count_below(x: str, cuts: Sequence[float], lo: int, hi: int) -> str:
    """SQL for the number of entries of the sorted ``cuts`` that are < x, knowing it lies in
    [lo, hi]: a binary search as nested CASE (one expression, built in one call)."""
    if lo == hi:
        return str(lo)
    mid = (lo + hi) // 2
    return f"CASE WHEN {_dbl(cuts[mid])} < {x} THEN {_count_below(x, cuts, mid + 1, hi)} ELSE {_count_below(x, cuts, lo, mid)} END"


def _dbl(x: float) -> str:
    """A double as SQL, exactly."""
    if x != x or x in (float("inf"), float("-inf")):
        return f"double('{x}')"
    return f"{float(x)!r}D"


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Distinct values ``__x`` (as DOUBLE, no NULLs) and how often each occurs, ``__c``."""
    vals = df.selectExpr(f"CAST(`{col}` AS DOUBLE) AS __x").where("__x IS NOT NULL")
    return vals.groupBy("__x").agg(F.expr("count(1) AS __c"))


@dataclass
class _Interval:
    """Values above ``low`` and up to ``high`` (None: without end), ``before`` rows below them."""

    rank: int
    low: float | None
    high: float | None
    before: int
    values: int
    cuts: list[float] = field(default_factory=list)

    def holds(self) -> str:
        """SQL for whether ``__x`` is in it."""
        ends = [f"__x > {_dbl(self.low)}" for _ in [0] if self.low is not None] + [f"__x <= {_dbl(self.high)}" for _ in [0] if self.high is not None]
        return " AND ".join(ends) or "true"


def _narrowed(counts: DataFrame, at: _Interval, pivots: int, accuracy: int) -> _Interval:
    """A round: the bucket of the interval that holds the rank."""
    cuts = sorted(set(at.cuts))
    shares = ", ".join(_dbl(i / pivots) for i in range(1, pivots))
    bucket = _count_below("__x", cuts, 0, len(cuts))
    rows = counts.where(at.holds()).selectExpr("__x", "__c", f"{bucket} AS __b").groupBy("__b")
    found = rows.agg(F.expr("sum(__c) AS c"), F.expr("count(1) AS v"), F.expr(f"percentile_approx(__x, array({shares}), {accuracy}) AS cuts"))
    before = at.before
    for r in sorted(found.collect(), key=lambda r: r["__b"]):  # at most `pivots` rows
        if at.rank <= before + r["c"]:
            b = r["__b"]
            return _Interval(at.rank, cuts[b - 1] if b else at.low, cuts[b] if b < len(cuts) else at.high, before, r["v"], list(r["cuts"]))
        before += r["c"]
    raise ValueError("the values changed while they were counted")


def counted_percentiles(counts: DataFrame, ps: Sequence[float], pivots: int = 128, max_sorted: int = 100_000, accuracy: int = 10000) -> list[float | None]:
    """Exact percentiles of a table of ``value_counts``, which should be written: it is read several times. Runs
    a few jobs."""
    shares = ", ".join(_dbl(i / pivots) for i in range(1, pivots))
    n, values, cuts = counts.agg(F.expr("sum(__c)"), F.expr("count(1)"), F.expr(f"percentile_approx(__x, array({shares}), {accuracy})")).first()
    if not n:
        return [None] * len(ps)
    intervals: list[_Interval] = []
    for p in ps:
        at = _Interval(max(1, math.ceil(n * float(p))), None, None, 0, values, list(cuts))
        while at.values > max_sorted and len(set(at.cuts)) > 1:
            at = _narrowed(counts, at, pivots, accuracy)
        intervals.append(at)
    # One job for all: each interval's values are sorted by themselves.
    each = ", ".join(f"named_struct('j', {j}, 'r', {at.rank}L, 's', {at.before}L, 'in', {at.holds()})" for j, at in enumerate(intervals))
    rows = counts.where(" OR ".join(f"({at.holds()})" for at in intervals)).selectExpr("__x", "__c", f"explode(filter(array({each}), t -> t.in)) AS t")
    running = "t.s + sum(__c) OVER (PARTITION BY t.j ORDER BY __x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum"
    hit = rows.selectExpr("__x", "__c", "t.j AS j", "t.r AS r", running).where("cum >= r AND cum - __c < r")
    found = {r["j"]: r["__x"] for r in hit.select("j", "__x").collect()}  # a row for each percentile
    return [found[j] for j in range(len(intervals))]


def percentiles(
    df: DataFrame,
    col: str,
    ps: Sequence[float],
    names: Sequence[str],
    exact: bool = True,
    pivots: int = 128,
    accuracy: int = 10000,
    max_sorted: int = 100_000,
) -> DataFrame:
    """One-row DataFrame with a DOUBLE column per requested percentile (NULLs ignored). The exact form runs
    its jobs when it is called, and the result holds the numbers; the approximate one is lazy."""
    if len(ps) != len(names):
        raise ValueError("one name per percentile")
    if not exact:
        vals = df.selectExpr(f"CAST(`{col}` AS DOUBLE) AS __x").where("__x IS NOT NULL")
        wanted = ", ".join(_dbl(p) for p in ps)
        return vals.selectExpr(f"percentile_approx(__x, array({wanted}), {accuracy}) AS __q").selectExpr(
            *[f"__q[{i}] AS `{n}`" for i, n in enumerate(names)]
        )
    from aislewise.session import materialize

    found = counted_percentiles(materialize(value_counts(df, col)), ps, pivots, max_sorted, accuracy)
    return one_row(df, found, names)


def one_row(df: DataFrame, values: Sequence[float | None], names: Sequence[str]) -> DataFrame:
    """A row of doubles, in the session of ``df``."""
    return df.sparkSession.range(1).selectExpr(*[f"CAST({'NULL' if v is None else _dbl(v)} AS DOUBLE) AS `{n}`" for v, n in zip(values, names, strict=True)])
