"""Ordered window helpers. SQL's default frame for an ordered aggregate is
RANGE UNBOUNDED PRECEDING .. CURRENT ROW (peers share a value); NULL order
keys sort last, as in the reference's SQL dialect.

A window with no partition runs in one task. These helpers are meant for
aggregated series (one row per day or per campaign-day); their size grows with
the calendar, not with the data. For tables of any size see ``operators.prefix``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from orderlytics.functions import MONEY_SUM, percent


def ordered(order: str, partition: Sequence[str] = ()) -> WindowSpec:
    w = Window.partitionBy(*partition) if partition else Window
    return w.orderBy(F.col(order).asc_nulls_last())


def running(order: str = "dt", partition: Sequence[str] = ()) -> WindowSpec:
    return ordered(order, partition).rangeBetween(Window.unboundedPreceding, Window.currentRow)


def running_sum(c: str | Column, order: str = "dt", partition: Sequence[str] = (),
                money: bool = True) -> Column:
    expr = F.sum(F.col(c) if isinstance(c, str) else c).over(running(order, partition))
    return expr.cast(MONEY_SUM) if money else expr


def running_totals(df: DataFrame, cols: Sequence[str], order: str = "dt",
                   partition: Sequence[str] = (), prefix: str = "total_") -> DataFrame:
    """Add ``total_<c>`` running sums for each column."""
    return df.select("*", *[running_sum(c, order, partition).alias(prefix + c) for c in cols])


def lag(c: str, order: str = "dt", partition: Sequence[str] = (), offset: int = 1) -> Column:
    return F.lag(c, offset).over(ordered(order, partition))


def pct_change(c: str, order: str = "dt", partition: Sequence[str] = ()) -> Column:
    """ROUND(100 * (x - LAG(x)) / LAG(x), 2); NULL on the first row."""
    prev = lag(c, order, partition)
    return percent(F.col(c) - prev, prev)


def row_number(order: str = "dt", partition: Sequence[str] = ()) -> Column:
    return F.row_number().over(ordered(order, partition)).cast("bigint")
