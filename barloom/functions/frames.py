"""Window frames and null rules shared by all metrics: what can't be computed is null, never zero or false."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F



def by():
    """One spec for everything by symbol, so the planner sorts once. (A function: specs need a running session.)"""
    return Window.partitionBy("token").orderBy("trade_date")


def by_date():
    return Window.partitionBy("trade_date")


def last(n: int):
    """The frame of the last n sessions, today included."""
    return by().rowsBetween(1 - n, 0)


def before(n: int):
    """The frame of the n sessions before today."""
    return by().rowsBetween(-n, -1)


def full(col: Column, n: int, agg: Callable[[Column], Column], frame=None) -> Column:
    """An aggregate over n sessions; null unless all of them have a value."""
    frame = frame or last(n)
    return F.when(F.count(col).over(frame) == n, agg(col).over(frame))


def over(num: Column, den: Column) -> Column:
    """num / den where den is positive, else null."""
    return F.when(den > 0, num / den)


def change(col: Column, n: int) -> Column:
    """Return over n sessions; null without a positive price then."""
    return over(col, F.lag(col, n).over(by())) - 1


def tri(value: Column, *inputs: Column) -> Column:
    """A condition that is null while any of its inputs is unknown."""
    known = inputs[0].isNotNull()
    for c in inputs[1:]:
        known = known & c.isNotNull()
    return F.when(known, F.coalesce(value, F.lit(False)))


def flag(condition: Column) -> Column:
    """1 if the condition holds, 0 if it doesn't or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def percentile_rank(name: str, keys: list[str]) -> Column:
    """Mid-rank of ties over n - 1, among the non-null values of a column by keys; 1 for a single value."""
    group = Window.partitionBy(*keys)
    col = F.col(name)
    n = F.count(col).over(group)
    rank = F.rank().over(group.orderBy(col.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, name))
    return F.when(col.isNotNull(), F.when(n == 1, 1.0).otherwise((rank - 1 + (ties - 1) / 2) / (n - 1)))


def winsorised(col: Column, window) -> Column:
    """The value held between the 1st and 99th percentile (linear) of the window."""
    low, high = F.percentile(col, F.lit(0.01)).over(window), F.percentile(col, F.lit(0.99)).over(window)
    return F.when(col.isNotNull(), F.least(F.greatest(col, low), high))


def zscore(col: Column, window) -> Column:
    """(x - mean) / sample deviation; 0 where the deviation is 0, null with under two values."""
    sd = F.stddev_samp(col).over(window)
    n = F.count(col).over(window)
    return F.when(col.isNotNull() & (n > 1), F.when(sd > 0, (col - F.avg(col).over(window)) / sd).otherwise(0.0))
