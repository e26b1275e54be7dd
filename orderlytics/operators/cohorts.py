"""Cohort retention: users grouped by the day they were first seen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlytics.functions import day, day_number, month_start, ratio


def cohort_activity(user_actions: DataFrame, partition: Sequence[str] = ()) -> DataFrame:
    """[partition..,] start_date, dt, users.

    Actions are first reduced to distinct (user, day) pairs (a map-side
    combined aggregate, so a very active user shrinks to one row per day); the
    per-user first day is then a window over at most one row per active day of
    that user, and ``users`` a plain count, equal to COUNT(DISTINCT user_id)."""
    pairs = user_actions.select(*partition, "user_id", day("time").alias("dt")).distinct()
    first = F.min("dt").over(Window.partitionBy(*partition, "user_id"))
    return (pairs.withColumn("start_date", first)
            .groupBy(*partition, "start_date", "dt")
            .agg(F.count("user_id").alias("users")))


def retention(cohorts: DataFrame, partition: Sequence[str] = (),
              days: Sequence[int] | None = None) -> DataFrame:
    """[partition..,] start_date, day_number, users, retention.

    The denominator is the cohort's size, i.e. its largest day (every user is
    active on their start day), taken before ``days`` filters the rows. The
    window runs over cohort rows (one per cohort and day), not over actions."""
    size = F.max("users").over(Window.partitionBy(*partition, "start_date"))
    out = cohorts.select(
        *partition, "start_date",
        day_number("dt", "start_date").alias("day_number"),
        "users",
        ratio("users", size).alias("retention"))
    if days is not None:
        out = out.filter(F.col("day_number").isin(list(days)))
    return out


def with_start_month(df: DataFrame) -> DataFrame:
    return df.withColumn("start_month", month_start("start_date"))
