"""Fact-level building blocks: cancellations, valid orders, order lines,
campaign attribution.

Scale notes
-----------
* A cancelled order is excluded with a ``left_anti`` join against the ids of the
  cancel rows, as they come. ``NOT IN (subquery)`` would plan as a null-aware broadcast
  anti join whatever the size of the subquery; the window formulation
  (``COUNT(...) FILTER (...) OVER (PARTITION BY order_id)``) shuffles the whole
  action log and blocks filter pushdown. The ids are not made distinct first: an
  aggregate between the shuffle and the join would keep AQE from splitting a
  skewed probe partition, and a repeated id changes no anti join.
* No broadcast hints on tables that grow with the data (products, members):
  Spark broadcasts them only when its size estimate, or AQE's runtime size,
  is under ``spark.sql.autoBroadcastJoinThreshold``; otherwise sort-merge.
* Actions of hot order ids, and those without order id, go their own way through the
  joins on the order id (``operators.skew``).
* A date window on actions or orders prunes the order lines before their shuffle
  (``operators.pruning``).
* Where order ids are hot, what only needs an order's price joins to one row per order,
  summed map-side below the join, rather than to its lines (``order_prices``); what only
  needs a product's revenue looks its price up once (``product_revenue``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlytics.functions import MONEY_SUM, day, money_total
from orderlytics.operators.pruning import id_bitmap, prune
from orderlytics.operators.skew import HotKeys, Route, hot_keys, routed, split_join
from orderlytics.sources.params import Campaigns
from orderlytics.sources.tables import CANCEL, Shop


def cancelled_orders(user_actions: DataFrame) -> DataFrame:
    """Distinct ids of orders that have any ``cancel_order`` action.

    Cancel rows without an order id name no order and cancel none (under ``NOT
    IN`` a single NULL there would empty every result)."""
    return cancel_ids(user_actions).distinct()


def cancel_ids(user_actions: DataFrame) -> DataFrame:
    """The order id of every ``cancel_order`` action that has one; ids may repeat."""
    return (user_actions
            .filter((F.col("action") == CANCEL) & F.col("order_id").isNotNull())
            .select("order_id"))


def cancelled_of(shop: Shop) -> DataFrame:
    """The shop's cancelled order ids, possibly repeated (prepared once if the shop
    was prepared)."""
    if shop.cancelled_ids is not None:
        return shop.cancelled_ids
    return cancel_ids(shop.user_actions)


def hot_orders(shop: Shop) -> HotKeys:
    """The order ids that hold much of the action log, measured once per shop."""
    if "hot_orders" not in shop.measured:
        shop.measured["hot_orders"] = hot_keys(shop.user_actions, "order_id")
    return shop.measured["hot_orders"]


def without_cancelled(df: DataFrame, cancelled: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Rows whose order was never cancelled; rows without an order id stay.
    Equal to filtering ``is_canceled = 0`` on the window cancel flag."""
    return split_join(df, cancelled, "order_id", "left_anti", hot)


def valid(df: DataFrame, cancelled: DataFrame) -> DataFrame:
    """``WHERE order_id NOT IN (cancelled ids)``: rows without an order id drop
    out too, as they do under NOT IN when any order was cancelled."""
    return without_cancelled(df.filter(F.col("order_id").isNotNull()), cancelled)


def valid_orders(shop: Shop, cancelled: DataFrame | None = None) -> DataFrame:
    cancelled = cancelled_of(shop) if cancelled is None else cancelled
    return valid(shop.orders, cancelled)


def aggregate_over(df: DataFrame, keys: Sequence[str], agg: Column, name: str) -> DataFrame:
    """``agg OVER (PARTITION BY keys)`` added to every row as ``name``.

    Written as a partial aggregate joined back on the keys rather than a window:
    a window puts every row of one key in one task, while the aggregate combines
    map-side and the join lets AQE split a hot key. The join is null-safe, so
    rows with NULL keys form one group, as they do in a window partition."""
    per_key = df.groupBy(*keys).agg(agg.alias(name)).alias("__g")
    rows = df.alias("__r")
    cond = [F.col(f"__r.{k}").eqNullSafe(F.col(f"__g.{k}")) for k in keys]
    return rows.join(per_key, cond, "left").select("__r.*", F.col(f"__g.{name}"))


def count_where_over(df: DataFrame, keys: Sequence[str], predicate: Column, name: str,
                     value: str | None = None) -> DataFrame:
    """``COUNT(value) FILTER (WHERE predicate) OVER (PARTITION BY keys)``."""
    counted = F.when(predicate, F.col(value) if value else F.lit(1))
    return aggregate_over(df, keys, F.count(counted), name)


def cancel_flag(user_actions: DataFrame) -> DataFrame:
    """The actions with ``is_canceled``: how many cancel rows their order has."""
    return count_where_over(user_actions, ["order_id"], F.col("action") == CANCEL,
                            "is_canceled", value="action")


def order_items(shop: Shop) -> DataFrame:
    """order_id, product_id for every order line (bag: a repeated product repeats)."""
    if shop.order_items is not None:
        return shop.order_items
    return shop.orders.select("order_id", F.explode("product_ids").alias("product_id"))


def existing_order_items(shop: Shop, bitmap: DataFrame | None = None) -> DataFrame:
    """order_id, product_id of the lines as unnesting the orders gives them: one
    per (order row, item); normalised items of unknown orders are dropped. ``bitmap``
    (``operators.pruning``) drops other orders right after the scans."""
    pick = (lambda df: df) if bitmap is None else (lambda df: prune(df, "order_id", bitmap))
    if shop.order_items is None:
        return pick(shop.orders).select("order_id", F.explode("product_ids").alias("product_id"))
    return pick(shop.order_headers().select("order_id")).join(pick(shop.order_items), "order_id")


def within(c: str, window: tuple) -> Column:
    """``[start, end)`` on a zone-less timestamp; the raw comparison to typed bounds
    reaches the Parquet scan."""
    start, end = (F.lit(edge).cast("timestamp_ntz") for edge in window)
    return (F.col(c) >= start) & (F.col(c) < end)


def valid_items(shop: Shop, cancelled: DataFrame, created: tuple | None = None) -> DataFrame:
    """order_id, creation_time, product_id of the lines of valid orders, optionally of
    orders created within ``[start, end)``; lines of others are pruned right after their
    scan. Orders with a NULL or empty product list contribute no line."""
    orders = shop.orders if created is None else shop.orders.filter(within("creation_time", created))
    if shop.order_items is not None:
        headers = orders.select("order_id", "creation_time")
        items = shop.order_items
        if created is not None:
            items = prune(items, "order_id", id_bitmap(headers, "order_id"))
        return valid(headers, cancelled).join(items, "order_id")
    return valid(orders, cancelled).select(
        "order_id", "creation_time", F.explode("product_ids").alias("product_id"))


def with_products(lines: DataFrame, products: DataFrame) -> DataFrame:
    """LEFT JOIN products USING (product_id): unknown products get NULL name and price."""
    return lines.join(products, "product_id", "left")


def _is_prepared(shop: Shop, cancelled: DataFrame | None) -> bool:
    return shop.priced_lines is not None and (cancelled is None or cancelled is shop.cancelled_ids)


def order_lines(shop: Shop, cancelled: DataFrame | None = None, created: tuple | None = None) -> DataFrame:
    """order_id, creation_time, product_id, name, price for lines of valid orders
    (read from the prepared table when the shop was prepared), optionally of orders
    created within ``[start, end)``."""
    if _is_prepared(shop, cancelled):
        return shop.priced_lines if created is None else shop.priced_lines.filter(within("creation_time", created))
    cancelled = cancelled_of(shop) if cancelled is None else cancelled
    return with_products(valid_items(shop, cancelled, created), shop.products)


def product_revenue(shop: Shop, cancelled: DataFrame | None = None) -> DataFrame:
    """product_id, name, revenue of the lines of valid orders: the lines are counted by
    product first (map-side), and the price looked up once per product, so no line of a
    hot product crosses a shuffle by product. A product listed twice gives two rows, one
    of unknown price NULL."""
    if _is_prepared(shop, cancelled):
        return shop.priced_lines.groupBy("product_id", "name").agg(money_total("price").alias("revenue"))
    cancelled = cancelled_of(shop) if cancelled is None else cancelled
    sold = valid_items(shop, cancelled).groupBy("product_id").agg(F.count("*").alias("n"))
    revenue = F.col("price") * F.col("n").cast("decimal(19,0)")
    return with_products(sold, shop.products).select("product_id", "name", revenue.cast(MONEY_SUM).alias("revenue"))


def order_day_prices(shop: Shop, cancelled: DataFrame | None = None) -> DataFrame:
    """order_id, dt (creation day), order_price of valid orders that have lines; rows of
    an order may repeat, their sums are those over its lines. Normalised lines are priced
    and summed by order below the join to the order rows, partially in each task, so that
    the join sorts one row per order and no line."""
    if _is_prepared(shop, cancelled) or shop.order_items is None:
        return order_lines(shop, cancelled).groupBy("order_id", day("creation_time").alias("dt")).agg(
            money_total("price").alias("order_price"))
    cancelled = cancelled_of(shop) if cancelled is None else cancelled
    headers = valid(shop.order_headers(), cancelled).select("order_id", day("creation_time").alias("dt"))
    return headers.join(_item_sums(shop.order_items, shop), "order_id")


def _item_sums(items: DataFrame, shop: Shop) -> DataFrame:
    """order_id, order_price: SUM(price) over the items of each order."""
    return (with_products(items, shop.products.select("product_id", "price"))
            .groupBy("order_id").agg(money_total("price").alias("order_price")))


def order_prices(shop: Shop, bitmap: DataFrame | None = None) -> DataFrame:
    """order_id, order_price: SUM(price) over the lines of each order, one row per order
    that has lines (an order listed twice counts its lines twice). Lines are priced and
    summed by order below the join to the order rows, partially in each task. ``bitmap``
    (``operators.pruning``) drops other orders right after the scans."""
    pick = (lambda df: df) if bitmap is None else (lambda df: prune(df, "order_id", bitmap))
    if shop.order_items is None:
        return _item_sums(pick(shop.orders).select("order_id", F.explode("product_ids").alias("product_id")), shop)
    listed = pick(shop.order_headers().select("order_id"))
    return listed.join(_item_sums(pick(shop.order_items), shop), "order_id").groupBy("order_id").agg(
        money_total("order_price").alias("order_price"))


def tag_campaign(df: DataFrame, campaigns: Campaigns) -> DataFrame:
    """Every row with the campaign of its user as ``ads_campaign``, 0 for none. A members
    table is joined as it is, broadcast only if its measured size allows."""
    if campaigns.assign is not None:
        return df.withColumn("ads_campaign", F.coalesce(campaigns.assign.cast("int"), F.lit(0)))
    members = (campaigns.members
               .select(F.col("user_id").cast("bigint"), F.col("campaign_id").cast("int"))
               .groupBy("user_id").agg(F.min("campaign_id").alias("ads_campaign")))
    tagged = df.join(members, "user_id", "left")
    return tagged.withColumn("ads_campaign", F.coalesce("ads_campaign", F.lit(0)))


def reported(df: DataFrame, campaigns: Campaigns) -> DataFrame:
    """The rows of users in a reported campaign (the keys of ``campaigns.spend``), tagged."""
    return tag_campaign(df, campaigns).filter(F.col("ads_campaign").isin(sorted(campaigns.spend)))


def _reported_actions(shop: Shop, campaigns: Campaigns, window: tuple | None) -> DataFrame:
    """Actions of campaign users, on cancelled orders too, within the window if any.
    Half-open on the calendar day of a zone-less timestamp is half-open on the timestamp
    at midnight."""
    actions = shop.user_actions if window is None else shop.user_actions.filter(within("time", window))
    return reported(actions, campaigns)


def campaign_actions(shop: Shop, campaigns: Campaigns, cancelled: DataFrame | None = None,
                     window: tuple | None = None) -> DataFrame:
    """Actions of campaign users on never-cancelled orders, optionally within a
    ``[start, end)`` date window on the action day. The cancel test looks at
    all time: a cancellation after the window still excludes the order."""
    cancelled = cancelled_of(shop) if cancelled is None else cancelled
    return without_cancelled(_reported_actions(shop, campaigns, window), cancelled, hot_orders(shop))


def _with_orders(shop: Shop, campaigns: Campaigns, cancelled: DataFrame | None, window: tuple | None,
                 orders, once: bool) -> DataFrame:
    """The rows of ``campaign_actions`` left-joined on the order id to ``orders(bitmap)``,
    where ``bitmap`` names the orders of the window. Both joins, the cancel test and this
    one, are on the order id: hot and missing ids are told apart once for both."""
    cancelled = cancelled_of(shop) if cancelled is None else cancelled
    acts = _reported_actions(shop, campaigns, window).select("ads_campaign", "user_id", "order_id", "time")
    right = orders(None if window is None else id_bitmap(acts, "order_id"))

    def build(route: Route, rows: DataFrame) -> DataFrame:
        kept = route.join(rows, cancelled, "order_id", "left_anti")
        return route.join(kept, right, "order_id", "left", once)

    return routed(acts, hot_orders(shop), build)


def campaign_order_lines(shop: Shop, campaigns: Campaigns, cancelled: DataFrame | None = None,
                         window: tuple | None = None) -> DataFrame:
    """ads_campaign, user_id, order_id, time, product_id, price: each surviving
    action row joined to the lines of its order (an order with two surviving
    action rows counts twice, as in the row-level join it replaces). Actions of
    orders without lines keep one row with NULL product and price."""
    if _is_prepared(shop, cancelled):
        # The actions only touch never-cancelled orders, whose priced lines are prepared.
        priced = shop.priced_lines.select("order_id", "product_id", "price")
        return _with_orders(shop, campaigns, cancelled, window, lambda bitmap: priced, once=False)
    if shop.order_items is None:
        lines = _unnested(_with_orders(shop, campaigns, cancelled, window, lambda bitmap: _filled_orders(shop, bitmap), once=False))
    else:
        lines = _with_orders(shop, campaigns, cancelled, window, lambda bitmap: existing_order_items(shop, bitmap), once=False)
    return with_products(lines, shop.products.select("product_id", "price"))


def _filled_orders(shop: Shop, bitmap: DataFrame | None) -> DataFrame:
    """order_id, product_ids of the orders that have lines: a join sorts one row for each
    array, and ``_unnested`` gives the lines after it."""
    filled = shop.orders.select("order_id", "product_ids").filter(F.size("product_ids") > 0)
    return filled if bitmap is None else prune(filled, "order_id", bitmap)


def _unnested(rows: DataFrame) -> DataFrame:
    """A row per product of ``product_ids``; rows without an array keep one, of product NULL."""
    kept = [c for c in rows.columns if c != "product_ids"]
    return rows.select(*kept, F.explode_outer("product_ids").alias("product_id"))


def campaign_order_prices(shop: Shop, campaigns: Campaigns, cancelled: DataFrame | None = None,
                          window: tuple | None = None) -> DataFrame:
    """ads_campaign, user_id, order_id, time, order_price: rows whose sums of
    ``order_price`` equal those of ``price`` over ``campaign_order_lines``.

    Where the log has hot order ids, one row per surviving action with the price of its
    order, as one row per hot order is all that their actions must meet; else the lines
    themselves, which saves summing the orders that nobody asks for."""
    if not hot_orders(shop):
        lines = campaign_order_lines(shop, campaigns, cancelled, window)
        return lines.select("ads_campaign", "user_id", "order_id", "time", F.col("price").alias("order_price"))
    if _is_prepared(shop, cancelled):
        prices = shop.priced_lines.groupBy("order_id").agg(money_total("price").alias("order_price"))
        return _with_orders(shop, campaigns, cancelled, window, lambda bitmap: prices, once=True)
    return _with_orders(shop, campaigns, cancelled, window, lambda bitmap: order_prices(shop, bitmap), once=True)


def lines_of_actions(shop: Shop, acts: DataFrame) -> DataFrame:
    """``acts LEFT JOIN (order lines) USING (order_id)``, the lines taken from the
    orders table: an action of an order without lines, or of an order missing
    from ``orders``, keeps one row with a NULL product; an order listed twice
    gives its lines twice."""
    return split_join(acts, existing_order_items(shop), "order_id", "left", hot_orders(shop))
