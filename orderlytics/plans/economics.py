"""Unit-economics metrics E1-E7 (daily revenue, ARPU/ARPPU/AOV, weekday
metrics, new-user revenue, product shares, gross profit).

Each function takes a `Shop` (plus parameters) and returns the metric as a
DataFrame with its final column names and types: dates DATE, counts BIGINT,
money and ratios DECIMAL(38,2), exact. (The registry casts them to DOUBLE.)

Plan shape: the priced lines of valid orders come from one anti join of the
order headers against the cancelled ids and one join of headers to their lines
(both keyed by order id, so one partitioning serves both), then a products
lookup (broadcast only when its measured size allows). Each large input is read
once per metric: several series are derived from one partial aggregate whose
shuffle Spark reuses (E7), and what is known of users comes from one pass over
the actions (E2-E5). Windows run only over per-day series. A prepared shop
(``plans.dashboard``) supplies the cancelled ids and priced lines from Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlytics.functions import amount, day, day_name, iso_dow, money_total, percent, ratio
from orderlytics.operators import costs, daily, facts, shares, windows
from orderlytics.sources.params import WEEKDAY_WINDOW, CostModel, Folding, VatRule
from orderlytics.sources.tables import Shop


def e1_daily_revenue(shop: Shop) -> DataFrame:
    """dt, revenue, total_revenue, revenue_change (% vs the previous day)."""
    lines = facts.order_lines(shop)
    d = daily.daily_revenue(lines)
    return d.select(
        "dt",
        amount("revenue").alias("revenue"),
        amount(windows.running_sum("revenue")).alias("total_revenue"),
        amount(windows.pct_change("revenue")).alias("revenue_change"))


def _day_kpis(shop: Shop):
    cancelled = facts.cancelled_of(shop)
    lines = facts.order_lines(shop, cancelled)
    return cancelled, daily.daily_orders_revenue(lines)


def e2_arpu_arppu_aov(shop: Shop) -> DataFrame:
    """dt, arpu, arppu, aov per order day."""
    cancelled, base = _day_kpis(shop)
    users = daily.users_and_payers(shop.user_actions, cancelled, day("time"), facts.hot_orders(shop))
    t = daily.star(base, users.withColumnRenamed("_k", "dt"))
    return t.select(
        "dt",
        amount(ratio("revenue", "users")).alias("arpu"),
        amount(ratio("revenue", "paying_users")).alias("arppu"),
        amount(ratio("revenue", "orders")).alias("aov"),
    ).orderBy(F.col("dt").asc_nulls_last())


def e3_running_arpu(shop: Shop) -> DataFrame:
    """dt, running_arpu, running_arppu, running_aov: running revenue over running
    new users, new paying users and orders. Users who start on a day without
    revenue never enter the running counts (the series is the revenue days)."""
    cancelled, base = _day_kpis(shop)
    t = daily.star(base, daily.daily_new_users_and_payers(shop.user_actions, cancelled, facts.hot_orders(shop)))
    rev = windows.running_sum("revenue")
    return t.select(
        "dt",
        amount(ratio(rev, windows.running_sum("new_users", money=False))).alias("running_arpu"),
        amount(ratio(rev, windows.running_sum("new_paying_users", money=False))).alias("running_arppu"),
        amount(ratio(rev, windows.running_sum("orders", money=False))).alias("running_aov"))


def e4_weekday_arpu(shop: Shop, window: tuple = WEEKDAY_WINDOW) -> DataFrame:
    """weekday, weekday_number, arpu, arppu, aov over ``[start, end)`` on raw
    timestamps. Users are distinct over the whole window per weekday."""
    cancelled = facts.cancelled_of(shop)
    # The window filter on creation time reaches the orders scan (or the prepared
    # lines' Parquet scan); the orders left prune the lines after their scan.
    lines = facts.order_lines(shop, cancelled, created=window)
    sales = lines.groupBy(day_name("creation_time").alias("weekday")).agg(
        F.max(iso_dow("creation_time")).alias("weekday_number"),
        F.count_distinct("order_id").alias("orders"),
        money_total("price").alias("revenue"))
    acts = shop.user_actions.filter(facts.within("time", window))
    users = daily.users_and_payers(acts, cancelled, day_name("time"), facts.hot_orders(shop))
    t = daily.star(sales, users.withColumnRenamed("_k", "weekday"), on="weekday")
    return t.select(
        "weekday", "weekday_number",
        amount(ratio("revenue", "users")).alias("arpu"),
        amount(ratio("revenue", "paying_users")).alias("arppu"),
        amount(ratio("revenue", "orders")).alias("aov"),
    ).orderBy(F.col("weekday_number").asc_nulls_last())


def e5_new_user_share(shop: Shop) -> DataFrame:
    """dt, revenue, new_users_revenue, new_users_revenue_share,
    old_users_revenue_share. Revenue is by order creation day; new users'
    revenue by their action day (the two clocks of the metric)."""
    # One pass over the lines, reduced per order; daily revenue and each order's price are
    # both read from that aggregate's shuffle.
    per_order_day = facts.order_day_prices(shop)
    total = per_order_day.groupBy("dt").agg(money_total("order_price").alias("revenue"))
    prices = per_order_day.groupBy("order_id").agg(money_total("order_price").alias("order_price"))
    new = daily.first_day_revenue(shop.user_actions, prices, facts.hot_orders(shop))
    share = percent("new_users_revenue", "revenue")
    return total.join(new, "dt", "left").select(
        "dt",
        amount("revenue").alias("revenue"),
        amount("new_users_revenue").alias("new_users_revenue"),
        amount(share).alias("new_users_revenue_share"),
        amount(F.lit(100) - share).alias("old_users_revenue_share"))


def e6_product_share(shop: Shop, folding: Folding = Folding()) -> DataFrame:
    """product_name, revenue, share_in_revenue over all time; products whose
    rounded share is under the threshold are folded into one group."""
    by_name = facts.product_revenue(shop).groupBy("name").agg(money_total("revenue").alias("revenue"))
    with_share = shares.share_of_total(by_name, "revenue", "share_in_revenue")
    folded = shares.fold_small(with_share, "name", "revenue", "share_in_revenue",
                               folding.threshold, folding.label, out_key="product_name")
    return folded.select(
        "product_name",
        amount("revenue").alias("revenue"),
        amount("share_in_revenue").alias("share_in_revenue"),
    ).orderBy(F.col("revenue").desc_nulls_first())


def e7_gross_profit(shop: Shop, vat: VatRule = VatRule(), model: CostModel = CostModel()) -> DataFrame:
    """dt, revenue, costs, tax, gross_profit, running totals of the four, and the
    daily and running gross-profit ratios. Packing is counted by order creation
    day, deliveries and courier bonuses by delivery day."""
    cancelled = facts.cancelled_of(shop)
    lines = costs.line_vat(facts.order_lines(shop, cancelled), vat)
    sales = lines.groupBy(day("creation_time").alias("dt")).agg(
        F.count_distinct("order_id").alias("orders_packed"),
        money_total("price").alias("revenue"),
        money_total("tax").alias("tax"))
    counts = daily.star(sales, daily.daily_deliveries(shop.courier_actions, cancelled,
                                                      model.bonus_min_orders))
    days = counts.select("dt", "revenue", costs.daily_costs(counts, model).alias("costs"), "tax")
    gp = (F.col("revenue") - F.col("costs") - F.col("tax")).cast("decimal(20,2)")
    totals = days.select(
        "dt", "revenue", "costs", "tax", gp.alias("gross_profit"),
        windows.running_sum("revenue").alias("total_revenue"),
        windows.running_sum("costs").alias("total_costs"),
        windows.running_sum("tax").alias("total_tax"),
        windows.running_sum(gp).alias("total_gross_profit"))
    money_cols = ["revenue", "costs", "tax", "gross_profit", "total_revenue", "total_costs",
                  "total_tax", "total_gross_profit"]
    return totals.select(
        "dt", *[amount(c).alias(c) for c in money_cols],
        amount(percent("gross_profit", "revenue")).alias("gross_profit_ratio"),
        amount(percent("total_gross_profit", "total_revenue")).alias("total_gross_profit_ratio"))
