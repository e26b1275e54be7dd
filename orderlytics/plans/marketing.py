"""Marketing metrics M1-M6: CAC, ROI, first-week average check, retention,
campaign retention, cumulative ARPPU.

Campaign attribution is either a Column over user_id (no join at all) or a
members table joined on user_id; the campaign count is a parameter, so the
per-campaign totals joined back in M6 have a proven size bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlytics.functions import MONEY_SUM, amount, day, label, money_total, percent, ratio
from orderlytics.operators import cohorts, facts, windows
from orderlytics.sources.params import FIRST_WEEK, RETENTION_DAYS, Campaigns
from orderlytics.sources.tables import Shop


def _spend(campaigns: Campaigns) -> Column:
    """The spend of the row's campaign, as a CASE over the (few) campaigns."""
    expr = None
    for cid, amount in sorted(campaigns.spend.items()):
        cond = F.col("ads_campaign") == cid
        val = F.lit(amount).cast(MONEY_SUM)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr


def _avg(c: str | Column) -> Column:
    """AVG as exact decimal SUM / COUNT (NULLs ignored, all-NULL -> NULL)."""
    c = F.col(c) if isinstance(c, str) else c
    return ratio(money_total(c), F.count(c))


def m1_cac(shop: Shop, campaigns: Campaigns) -> DataFrame:
    """ads_campaign, cac: spend / distinct users with any action on a valid order."""
    acts = facts.campaign_actions(shop, campaigns)
    per = acts.groupBy("ads_campaign").agg(F.count_distinct("user_id").alias("users"))
    return per.select(
        label(campaigns.label_prefix, "ads_campaign").alias("ads_campaign"),
        amount(ratio(_spend(campaigns), "users")).alias("cac"),
    ).orderBy(F.col("cac").desc_nulls_first())


def m2_roi(shop: Shop, campaigns: Campaigns) -> DataFrame:
    """ads_campaign, roi: (revenue - spend) / spend * 100."""
    orders = facts.campaign_order_prices(shop, campaigns)
    per = orders.groupBy("ads_campaign").agg(money_total("order_price").alias("revenue"))
    spend = _spend(campaigns)
    return per.select(
        label(campaigns.label_prefix, "ads_campaign").alias("ads_campaign"),
        amount(percent(F.col("revenue") - spend, spend)).alias("roi"),
    ).orderBy(F.col("roi").desc_nulls_first())


def m3_avg_check(shop: Shop, campaigns: Campaigns, window: tuple = FIRST_WEEK) -> DataFrame:
    """ads_campaign, avg_check: the campaign mean of each user's mean order
    value (rounded to cents) over action days in ``[start, end)``. The cancel
    test looks at all time, so the window filters after it."""
    orders = facts.campaign_order_prices(shop, campaigns, window=window)
    per_order = orders.groupBy("ads_campaign", "user_id", "order_id").agg(
        money_total("order_price").alias("order_price"))
    per_user = per_order.groupBy("ads_campaign", "user_id").agg(
        _avg("order_price").alias("user_avg_check"))
    per_campaign = per_user.groupBy("ads_campaign").agg(_avg("user_avg_check").alias("avg_check"))
    return per_campaign.select(
        label(campaigns.label_prefix, "ads_campaign").alias("ads_campaign"),
        amount("avg_check").alias("avg_check"),
    ).orderBy(F.col("avg_check").desc_nulls_first())


def m4_retention(shop: Shop) -> DataFrame:
    """start_month, start_date, day_number, retention for every first-seen cohort
    and every later active day (all actions count, cancellations included)."""
    r = cohorts.retention(cohorts.cohort_activity(shop.user_actions))
    return cohorts.with_start_month(r).select(
        "start_month", "start_date", "day_number", amount("retention").alias("retention"))


def m5_campaign_retention(shop: Shop, campaigns: Campaigns,
                          days: Sequence[int] = RETENTION_DAYS) -> DataFrame:
    """ads_campaign, start_date, day_number, retention of campaign users on the
    given day numbers (day 0 included by default)."""
    tagged = facts.reported(shop.user_actions.select("user_id", "time"), campaigns)
    c = cohorts.cohort_activity(tagged, partition=["ads_campaign"])
    r = cohorts.retention(c, partition=["ads_campaign"], days=days)
    return r.select(
        label(campaigns.label_prefix, "ads_campaign").alias("ads_campaign"),
        "start_date", "day_number", amount("retention").alias("retention"))


def m6_cumulative_arppu(shop: Shop, campaigns: Campaigns) -> DataFrame:
    """ads_campaign, day, cumulative_arppu, cac. "Day n" numbers the campaign's
    revenue days (gaps collapse); running revenue is divided by the campaign's
    final number of buyers."""
    orders = facts.campaign_order_prices(shop, campaigns)
    # One pass: revenue per campaign, day and buyer, and on which of these days a buyer
    # is first seen. Both series come from it: a day's revenue and its new buyers, whose
    # sum over the days is the campaign's number of buyers.
    spent = orders.groupBy("ads_campaign", day("time").alias("dt"), "user_id").agg(
        money_total("order_price").alias("revenue"))
    first = F.min("dt").over(Window.partitionBy("ads_campaign", "user_id"))
    per_day = spent.withColumn("first", first).groupBy("ads_campaign", "dt").agg(
        money_total("revenue").alias("revenue"),
        F.count(F.when(F.col("dt").eqNullSafe(F.col("first")), F.col("user_id"))).alias("new_buyers"))
    buyers = F.sum("new_buyers").over(Window.partitionBy("ads_campaign"))
    t = per_day.withColumn("paying_users", buyers).withColumn("cac", ratio(_spend(campaigns), "paying_users"))
    part = ["ads_campaign"]
    n = windows.row_number("dt", part) - 1
    return t.select(
        label(campaigns.label_prefix, "ads_campaign").alias("ads_campaign"),
        F.concat(F.lit("Day "), n.cast("string")).alias("day"),
        amount(ratio(windows.running_sum("revenue", "dt", part), "paying_users"))
        .alias("cumulative_arppu"),
        amount("cac").alias("cac"))
