"""Per-day aggregates. Every distinct count groups on one distinct column, so
Spark plans it as two partial aggregations (by day and id, then by day): a hot
day is spread over its ids in the first shuffle and never lands in one task
as raw rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlytics.functions import day, money_total
from orderlytics.operators.facts import valid
from orderlytics.operators.skew import HotKeys, split_join
from orderlytics.sources.tables import DELIVER


def daily_revenue(lines: DataFrame, clock: str = "creation_time") -> DataFrame:
    """dt, revenue: SUM(price) by the day of ``clock``."""
    return lines.groupBy(day(clock).alias("dt")).agg(money_total("price").alias("revenue"))


def daily_orders_revenue(lines: DataFrame, clock: str = "creation_time") -> DataFrame:
    """dt, orders (distinct order ids that have lines), revenue."""
    return lines.groupBy(day(clock).alias("dt")).agg(
        F.count_distinct("order_id").alias("orders"),
        money_total("price").alias("revenue"))


def daily_active_users(user_actions: DataFrame) -> DataFrame:
    """dt, users: distinct users with any action that day (cancellations count)."""
    return user_actions.groupBy(day("time").alias("dt")).agg(
        F.count_distinct("user_id").alias("users"))


def daily_paying_users(user_actions: DataFrame, cancelled: DataFrame) -> DataFrame:
    """dt, paying_users: distinct users with an action on a valid order that day."""
    return valid(user_actions, cancelled).groupBy(day("time").alias("dt")).agg(
        F.count_distinct("user_id").alias("paying_users"))


def _flagged(actions: DataFrame, cancelled: DataFrame, hot: HotKeys | None) -> DataFrame:
    """``actions`` with ``_valid``: they have an order id, of an order never cancelled.
    An order cancelled twice repeats its actions."""
    marks = cancelled.withColumn("_cancelled", F.lit(True))
    marked = split_join(actions, marks, "order_id", "left", hot, once=True)
    return marked.withColumn("_valid", F.col("order_id").isNotNull() & F.col("_cancelled").isNull())


def users_and_payers(user_actions: DataFrame, cancelled: DataFrame, key, hot: HotKeys | None = None) -> DataFrame:
    """<key>, users, paying_users in one pass over the actions: distinct users
    with any action, and distinct users with an action on a valid order.

    Each action is flagged by a left join to the cancelled ids, reduced to one
    row per (key, user) carrying "paid" (a map-side combined aggregate), then
    counted. The same answer as two COUNT(DISTINCT) queries, with one scan and
    no row expansion."""
    key = key.alias("_k") if not isinstance(key, str) else F.col(key).alias("_k")
    flagged = _flagged(user_actions.select(key, "user_id", "order_id"), cancelled, hot)
    per_user = flagged.groupBy("_k", "user_id").agg(F.max("_valid").alias("_paid"))
    return per_user.groupBy("_k").agg(
        F.count("user_id").alias("users"),
        F.count(F.when(F.col("_paid") & F.col("user_id").isNotNull(), 1)).alias("paying_users"))


def first_days(user_actions: DataFrame) -> DataFrame:
    """user_id, start_date: the first day a user did anything."""
    return user_actions.groupBy("user_id").agg(F.min(day("time")).alias("start_date"))


def first_and_paid_days(user_actions: DataFrame, cancelled: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """user_id, start_date, paid_date: the first day a user did anything and the
    first day they acted on a valid order, from one aggregate over the actions
    (each action flagged by a left join to the cancelled ids)."""
    flagged = _flagged(user_actions.select("user_id", day("time").alias("dt"), "order_id"), cancelled, hot)
    return flagged.groupBy("user_id").agg(
        F.min("dt").alias("start_date"),
        F.min(F.when(F.col("_valid"), F.col("dt"))).alias("paid_date"))


def daily_new_users_and_payers(user_actions: DataFrame, cancelled: DataFrame,
                               hot: HotKeys | None = None) -> DataFrame:
    """dt, new_users, new_paying_users in one pass over the actions: each user's two
    first days become two rows, counted by one aggregate."""
    firsts = first_and_paid_days(user_actions, cancelled, hot)
    both = firsts.select("user_id", F.explode(F.array(
        F.struct(F.col("start_date").alias("dt"), F.lit(False).alias("paid")),
        F.struct(F.col("paid_date").alias("dt"), F.lit(True).alias("paid")))).alias("first"))
    return (both.select("user_id", "first.*").filter(F.col("dt").isNotNull()).groupBy("dt").agg(
        F.count(F.when(~F.col("paid"), F.col("user_id"))).alias("new_users"),
        F.count(F.when(F.col("paid"), F.col("user_id"))).alias("new_paying_users")))


def daily_new_users(user_actions: DataFrame, name: str = "new_users") -> DataFrame:
    """dt, new_users: users whose first action falls on that day."""
    return (first_days(user_actions)
            .groupBy(F.col("start_date").alias("dt"))
            .agg(F.count("user_id").alias(name)))


def daily_new_paying_users(user_actions: DataFrame, cancelled: DataFrame) -> DataFrame:
    """dt, new_paying_users: users whose first action on a valid order falls that day."""
    return daily_new_users(valid(user_actions, cancelled), "new_paying_users")


def order_price(lines: DataFrame) -> DataFrame:
    """order_id, order_price: SUM(price) over an order's lines."""
    return lines.groupBy("order_id").agg(money_total("price").alias("order_price"))


def user_day_revenue(user_actions: DataFrame, cancelled: DataFrame,
                     prices: DataFrame) -> DataFrame:
    """user_id, dt, revenue: valid action rows joined to their order's price,
    summed per user and action day (every action row of an order counts)."""
    acts = valid(user_actions, cancelled).select("user_id", day("time").alias("dt"), "order_id")
    return (acts.join(prices, "order_id", "left")
            .groupBy("user_id", "dt")
            .agg(money_total("order_price").alias("revenue")))


def first_day_revenue(user_actions: DataFrame, prices: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """dt, new_users_revenue: what users spent on their first day, by that day.
    The first day counts all actions, cancelled ones too; a user whose first-day
    orders were all cancelled contributes 0, as do actions without a user or day.

    ``prices`` has valid orders only, one row each, so one pass over the actions gives
    both the first day and the spending: the window runs over one row per user and day."""
    acts = user_actions.select("user_id", day("time").alias("dt"), "order_id")
    spent = (split_join(acts, prices, "order_id", "left", hot, once=True)
             .groupBy("user_id", "dt").agg(money_total("order_price").alias("revenue")))
    first = F.min("dt").over(Window.partitionBy("user_id"))
    known = F.col("user_id").isNotNull() & F.col("dt").isNotNull()
    return (spent.withColumn("start_date", first)
            .filter(F.col("dt").eqNullSafe(F.col("start_date")))
            .groupBy("dt")
            .agg(money_total(F.when(known, F.coalesce(F.col("revenue"), F.lit(0))).otherwise(F.lit(0)))
                 .alias("new_users_revenue")))


def delivered_orders(courier_actions: DataFrame, cancelled: DataFrame) -> DataFrame:
    """dt, orders_delivered: distinct valid orders delivered that day."""
    return (valid(courier_actions, cancelled)
            .filter(F.col("action") == DELIVER)
            .groupBy(day("time").alias("dt"))
            .agg(F.count_distinct("order_id").alias("orders_delivered")))


def bonus_couriers(courier_actions: DataFrame, cancelled: DataFrame,
                   min_orders: int) -> DataFrame:
    """dt, couriers_count: couriers who delivered at least ``min_orders``
    distinct valid orders that day (GROUP BY day, courier HAVING ...)."""
    per_courier = (valid(courier_actions, cancelled)
                   .filter(F.col("action") == DELIVER)
                   .groupBy(day("time").alias("dt"), "courier_id")
                   .agg(F.count_distinct("order_id").alias("orders_delivered"))
                   .filter(F.col("orders_delivered") >= min_orders))
    return per_courier.groupBy("dt").agg(F.count("courier_id").alias("couriers_count"))


def daily_deliveries(courier_actions: DataFrame, cancelled: DataFrame,
                     min_orders: int) -> DataFrame:
    """dt, orders_delivered, couriers_count. Valid deliveries are reduced once
    to distinct (day, courier, order); both counts are read from that one
    shuffle. A bonus day is always a delivery day, so a left join suffices."""
    per_courier_order = (valid(courier_actions, cancelled)
                         .filter(F.col("action") == DELIVER)
                         .select(day("time").alias("dt"), "courier_id", "order_id")
                         .distinct())
    delivered = per_courier_order.groupBy("dt").agg(
        F.count_distinct("order_id").alias("orders_delivered"))
    busy = (per_courier_order.groupBy("dt", "courier_id")
            .agg(F.count("order_id").alias("n"))
            .filter(F.col("n") >= min_orders)
            .groupBy("dt").agg(F.count("courier_id").alias("couriers_count")))
    return delivered.join(busy, "dt", "left")


def star(base: DataFrame, *others: DataFrame, on: str = "dt") -> DataFrame:
    """``base LEFT JOIN o1 USING (on) LEFT JOIN o2 USING (on) ...``. The inputs
    are per-day aggregates (one row per day), so these joins are small; AQE
    broadcasts them from their measured size."""
    return reduce(lambda acc, o: acc.join(o, on, "left"), others, base)
