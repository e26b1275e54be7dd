"""Shares of a total and folding of small groups."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlytics.functions import money_total, percent


def grand_total(df: DataFrame, value: str) -> Column:
    """``SUM(value) OVER ()`` as a scalar subquery: computed once by its own
    (partially aggregated) job and used as a constant, so there is neither a
    single-partition window over all rows nor a cross join."""
    return df.agg(money_total(value)).scalar()


def share_of_total(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """Add ``name`` = ROUND(100 * value / SUM(value) OVER (), 2)."""
    return df.withColumn(name, percent(value, grand_total(df, value)))


def fold_small(df: DataFrame, key: str, value: str, share: str, threshold: Decimal,
               label: str, out_key: str | None = None) -> DataFrame:
    """Groups whose (rounded) share is under ``threshold`` are merged into one
    group named ``label``; values and shares are summed per resulting group."""
    out_key = out_key or key
    folded = F.when(F.col(share) >= F.lit(threshold), F.col(key)).otherwise(F.lit(label))
    return (df.groupBy(folded.alias(out_key))
            .agg(money_total(value).alias(value), money_total(share).alias(share)))
