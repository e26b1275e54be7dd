"""One registered query per operator of the inventory (scans, predicates, joins,
aggregates, windows, sorts, scalar functions, composite building blocks).

Each query runs the library operator over the whole test tables, the way the
metrics use it, and has an independent DuckDB twin in ``ORACLE``. Money and
ratios leave as DOUBLE after exact decimal rounding, counts as BIGINT.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlytics.functions import (MONEY_SUM, day, day_name, day_number, iso_dow, label,
                                   money_total, month_start, out_num, ratio, round2)
from orderlytics.operators import cohorts, costs, daily, facts, prefix, shares, windows
from orderlytics.plans import oracle as o
from orderlytics.sources import testdata as td
from orderlytics.sources.params import CAMPAIGN_LABEL as CAMPAIGN_LABEL_DEFAULT

CAMPAIGN_LABEL = CAMPAIGN_LABEL_DEFAULT


def _shop(s, d):
    return td.shop(s, d)


def _cancelled(shop):
    return facts.cancelled_of(shop)


def _lines(shop):
    return facts.order_lines(shop, _cancelled(shop))


def _ts(x):
    return F.lit(x).cast("timestamp_ntz")


def _dbl(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[out_num(c).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- 2.1 scans
def scan_user_actions(s, d):
    return _shop(s, d).user_actions


def scan_orders(s, d):
    """The orders role per order: header, number of lines and sum of product
    ids (an order-insensitive digest of the product list), aggregated from the
    normalised lines with map-side partial aggregation."""
    shop = _shop(s, d)
    per_order = facts.order_items(shop).groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("product_id").alias("items_sum"))
    return shop.order_headers().join(per_order, "order_id", "left")


def scan_order_arrays(s, d):
    """The lines of every order as arrays of at most 64 product ids, in text form."""
    arrays = prefix.in_arrays(facts.order_items(_shop(s, d)), "order_id", "product_id", "product_ids")
    text = F.transform("product_ids", lambda x: F.coalesce(x.cast("string"), F.lit("-")))
    return arrays.select("order_id", "part", F.size("product_ids").cast("bigint").alias("n_items"),
                         F.array_join(text, ",").alias("product_ids"))


def scan_products(s, d):
    return _dbl(_shop(s, d).products, "price")


def scan_courier_actions(s, d):
    return _shop(s, d).courier_actions


# ------------------------------------------------ 2.2 projection and filters
def project_alias(s, d):
    return _shop(s, d).order_headers().select(F.col("order_id").alias("id"),
                                     day("creation_time").alias("dt"))


def _weekday_counts(shop):
    by_orders = (shop.order_headers().groupBy(day_name("creation_time").alias("weekday"))
          .agg(F.max(iso_dow("creation_time")).alias("weekday_number"),
               F.count("order_id").alias("orders")))
    by_users = (shop.user_actions.groupBy(day_name("time").alias("weekday"))
          .agg(F.max(iso_dow("time")).alias("weekday_number"),
               F.count_distinct("user_id").alias("users")))
    return by_orders, by_users


def project_qualified(s, d):
    by_orders, by_users = _weekday_counts(_shop(s, d))
    j = by_orders.alias("o").join(by_users.alias("u"), F.col("o.weekday") == F.col("u.weekday"),
                                  "left")
    return j.select(F.col("o.weekday").alias("weekday"),
                    F.col("o.weekday_number").alias("weekday_number"),
                    F.col("o.orders").alias("orders"), F.col("u.users").alias("users"))


def filter_eq(s, d):
    return (_shop(s, d).user_actions.filter(F.col("action") == "cancel_order")
            .select("user_id", "order_id", "time"))


def filter_and(s, d):
    return (facts.campaign_actions(_shop(s, d), td.campaigns(), window=td.FIRST_WEEK)
            .select("ads_campaign", "user_id", "order_id"))


def filter_in_list(s, d):
    return (facts.reported(_shop(s, d).user_actions, td.campaigns())
            .select("user_id", "order_id", "ads_campaign"))


def filter_date_range(s, d):
    start, end = td.FIRST_WEEK
    ua = _shop(s, d).user_actions
    return (ua.filter((F.col("time") >= _ts(start)) & (F.col("time") < _ts(end)))
            .select("user_id", "order_id", "time"))


def filter_ts_range(s, d):
    start, end = td.WEEKDAY_WINDOW
    return (_shop(s, d).order_headers()
            .filter((F.col("creation_time") >= _ts(start)) & (F.col("creation_time") < _ts(end))))


def valid_orders_not_in(s, d):
    shop = _shop(s, d)
    return facts.valid(shop.user_actions, _cancelled(shop))


def cancel_flag_filter(s, d):
    shop = _shop(s, d)
    return facts.without_cancelled(shop.user_actions, _cancelled(shop)).select(
        "user_id", "order_id", "action", "time")


# ---------------------------------------------------------------- 2.3 joins
def order_to_lines_left(s, d):
    shop = _shop(s, d)
    acts = facts.campaign_actions(shop, td.campaigns()).select("ads_campaign", "user_id", "order_id")
    return facts.lines_of_actions(shop, acts)


def lines_to_products_left(s, d):
    shop = _shop(s, d)
    return _dbl(facts.with_products(facts.existing_order_items(shop), shop.products), "price")


def _day_star(shop):
    cancelled = _cancelled(shop)
    return daily.star(daily.daily_orders_revenue(facts.order_lines(shop, cancelled)),
                      daily.daily_active_users(shop.user_actions),
                      daily.daily_paying_users(shop.user_actions, cancelled))


def daily_star_left(s, d):
    return _dbl(_day_star(_shop(s, d)), "revenue")


def weekday_star_left(s, d):
    shop = _shop(s, d)
    cancelled = _cancelled(shop)
    lines = facts.order_lines(shop, cancelled)
    sales = lines.groupBy(day_name("creation_time").alias("weekday")).agg(
        F.max(iso_dow("creation_time")).alias("weekday_number"),
        F.count_distinct("order_id").alias("orders"), money_total("price").alias("revenue"))
    users = shop.user_actions.groupBy(day_name("time").alias("weekday")).agg(
        F.count_distinct("user_id").alias("users"))
    payers = facts.valid(shop.user_actions, cancelled).groupBy(day_name("time").alias("weekday")).agg(
        F.count_distinct("user_id").alias("paying_users"))
    return _dbl(daily.star(sales, users, payers, on="weekday"), "revenue")


def first_day_revenue_join(s, d):
    shop = _shop(s, d)
    cancelled = _cancelled(shop)
    prices = daily.order_price(facts.order_lines(shop, cancelled))
    starts = daily.first_days(shop.user_actions).alias("s")
    spent = daily.user_day_revenue(shop.user_actions, cancelled, prices).alias("r")
    j = starts.join(spent, (F.col("s.user_id") == F.col("r.user_id"))
                    & (F.col("s.start_date") == F.col("r.dt")), "left")
    return j.select(F.col("s.user_id").alias("user_id"), F.col("s.start_date").alias("start_date"),
                    out_num(F.coalesce(F.col("r.revenue"), F.lit(0).cast(MONEY_SUM)))
                    .alias("revenue"))


def cancelled_anti_join(s, d):
    shop = _shop(s, d)
    return facts.valid(shop.courier_actions, _cancelled(shop))


def _campaign_day_totals(shop):
    c = td.campaigns()
    main = facts.campaign_order_lines(shop, c)
    per_day = main.groupBy("ads_campaign", day("time").alias("dt")).agg(
        money_total("price").alias("revenue"))
    totals = main.groupBy("ads_campaign").agg(F.count_distinct("user_id").alias("paying_users"))
    return per_day.join(totals, "ads_campaign", "left")


def campaign_totals_join(s, d):
    return _dbl(_campaign_day_totals(_shop(s, d)), "revenue")


# ----------------------------------------------------------- 2.4 aggregates
def agg_sum(s, d):
    return _dbl(facts.product_revenue(_shop(s, d)).groupBy("product_id").agg(
        money_total("revenue").alias("revenue")), "revenue")


def _vat_lines(shop):
    return costs.line_vat(_lines(shop), td.vat_rule())


def agg_sum_of_rounded(s, d):
    return _dbl(_vat_lines(_shop(s, d)).groupBy(day("creation_time").alias("dt"))
                .agg(money_total("tax").alias("tax")), "tax")


def agg_count(s, d):
    shop = _shop(s, d)
    return facts.valid_items(shop, _cancelled(shop)).groupBy("order_id").agg(
        F.count("product_id").alias("n_lines"))


def agg_count_distinct(s, d):
    return _shop(s, d).courier_actions.groupBy("courier_id").agg(
        F.count_distinct("order_id").alias("orders"))


def agg_mixed_distinct(s, d):
    return _dbl(_lines(_shop(s, d)).groupBy(month_start(day("creation_time")).alias("month"))
                .agg(F.count_distinct("order_id").alias("orders"),
                     money_total("price").alias("revenue")), "revenue")


def agg_min(s, d):
    return daily.first_days(_shop(s, d).user_actions)


def agg_max(s, d):
    return _shop(s, d).order_headers().groupBy(day_name("creation_time").alias("weekday")).agg(
        F.max(iso_dow("creation_time")).alias("weekday_number"))


def agg_avg(s, d):
    p = _shop(s, d).products
    return p.groupBy("name").agg(out_num(ratio(money_total("price"), F.count("price"))).alias("avg_price"))


def _deliveries_per_courier(shop):
    return (facts.valid(shop.courier_actions, _cancelled(shop))
            .filter(F.col("action") == "deliver_order")
            .groupBy(day("time").alias("dt"), "courier_id")
            .agg(F.count_distinct("order_id").alias("orders_delivered")))


def agg_multi_key(s, d):
    return _deliveries_per_courier(_shop(s, d))


def agg_group_by_alias(s, d):
    return _shop(s, d).order_headers().withColumn("dt", day("creation_time")).groupBy("dt").agg(
        F.count("order_id").alias("orders"))


def agg_group_by_expr(s, d):
    return _shop(s, d).user_actions.groupBy(day("time").alias("dt")).agg(
        F.count("*").alias("actions"))


def agg_having(s, d):
    return _deliveries_per_courier(_shop(s, d)).filter(
        F.col("orders_delivered") >= td.cost_model().bonus_min_orders)


def agg_two_level(s, d):
    return _deliveries_per_courier(_shop(s, d)).groupBy("dt").agg(
        F.count("courier_id").alias("couriers"))


def agg_arith(s, d):
    return _vat_lines(_shop(s, d)).groupBy(day("creation_time").alias("dt")).agg(
        out_num(money_total("price") - money_total("tax")).alias("net_revenue"))


# -------------------------------------------------------------- 2.5 windows
def win_filtered_count(s, d):
    ca = _shop(s, d).courier_actions
    return facts.count_where_over(ca, ["order_id"], F.col("action") == "deliver_order",
                                  "n_deliveries", value="action")


def win_min(s, d):
    ua = _shop(s, d).user_actions
    rows = ua.select("user_id", day("time").alias("dt"))
    return facts.aggregate_over(rows, ["user_id"], F.min("dt"), "start_date")


def win_min_two_keys(s, d):
    acts = facts.reported(td.activity(s, d).select("user_id", "time"), td.campaigns())
    rows = acts.select("ads_campaign", "user_id", day("time").alias("dt"))
    return facts.aggregate_over(rows, ["ads_campaign", "user_id"], F.min("dt"), "start_date")


def win_max_ratio(s, d):
    per = facts.aggregate_over(_deliveries_per_courier(_shop(s, d)), ["dt"],
                               F.max("orders_delivered"), "best")
    return per.select(
        "dt", "courier_id", out_num(ratio("orders_delivered", "best")).alias("of_best"))


def _daily(shop):
    return daily.daily_revenue(_lines(shop))


def win_running_sum(s, d):
    return _daily(_shop(s, d)).select(
        "dt", out_num(windows.running_sum("revenue")).alias("total_revenue"))


def win_running_sum_part(s, d):
    t = _campaign_day_totals(_shop(s, d))
    return t.select("ads_campaign", "dt", out_num(windows.running_sum(
        "revenue", "dt", ["ads_campaign"])).alias("running_revenue"))


def _daily_rev_tax(shop):
    return _vat_lines(shop).groupBy(day("creation_time").alias("dt")).agg(
        F.count_distinct("order_id").alias("orders"),
        money_total("price").alias("revenue"), money_total("tax").alias("tax"))


def win_running_expr(s, d):
    t = _daily_rev_tax(_shop(s, d))
    return t.select("dt", out_num(windows.running_sum(F.col("revenue") - F.col("tax")))
                    .alias("running_net"))


def win_running_ratio(s, d):
    t = _daily_rev_tax(_shop(s, d))
    return t.select("dt", out_num(ratio(windows.running_sum("revenue"),
                                        windows.running_sum("orders", money=False)))
                    .alias("running_aov"))


def win_grand_total(s, d):
    t = shares.share_of_total(_daily(_shop(s, d)), "revenue", "share")
    return _dbl(t, "revenue", "share")


def win_lag(s, d):
    t = _daily(_shop(s, d))
    return _dbl(t.select("dt", "revenue", windows.lag("revenue").alias("prev_revenue")),
                "revenue", "prev_revenue")


def win_row_number(s, d):
    t = _campaign_day_totals(_shop(s, d))
    return t.select("ads_campaign", "dt",
                    windows.row_number("dt", ["ads_campaign"]).alias("day_number"))


# ------------------------------------- 2.5 windows over raw rows, range by range
def line_running_revenue(s, d):
    """Revenue up to each order line's moment, over all lines in time."""
    lines = _lines(_shop(s, d)).select("order_id", "product_id", "creation_time", "price")
    return _dbl(prefix.running_totals(lines, ["price"], ["creation_time"]), "price", "total_price")


def user_running_revenue(s, d):
    """What each campaign user has spent up to each of their order lines."""
    lines = facts.campaign_order_lines(_shop(s, d), td.campaigns()).select("user_id", "time", "order_id", "price")
    return _dbl(prefix.running_totals(lines, ["price"], ["time"], ["user_id"]), "price", "total_price")


def previous_action(s, d):
    """Each action with the time of the same user's action before it."""
    acts = _shop(s, d).user_actions
    return prefix.lag(acts, "time", ["time", "order_id", "action"], "previous_time", ["user_id"])


def action_number(s, d):
    """The whole action log numbered in time."""
    return prefix.row_number(_shop(s, d).user_actions, ["time", "user_id", "order_id", "action"], "number")


# ---------------------------------------------------------------- 2.6 sorts
def sort_asc(s, d):
    return _dbl(_daily(_shop(s, d)), "revenue").orderBy(F.col("dt").asc_nulls_last())


def sort_desc(s, d):
    t = _lines(_shop(s, d)).groupBy("name").agg(money_total("price").alias("revenue"))
    return _dbl(t, "revenue").orderBy(F.col("revenue").desc_nulls_first())


def sort_alias_shadow(s, d):
    t = _lines(_shop(s, d)).groupBy("name").agg(money_total("price").alias("price"))
    return _dbl(t.orderBy(F.col("price").desc_nulls_first()), "price")


# ------------------------------------------------------ 2.7 scalar functions
def fn_to_date(s, d):
    return _shop(s, d).user_actions.select("user_id", day("time").alias("dt"))


def fn_month_start(s, d):
    return _shop(s, d).user_actions.select("order_id", month_start(day("time")).alias("month"))


def fn_day_number(s, d):
    rows = _shop(s, d).user_actions.select("user_id", "order_id", day("time").alias("dt"))
    with_start = facts.aggregate_over(rows, ["user_id"], F.min("dt"), "start_date")
    return with_start.select(
        "user_id", "order_id", day_number("dt", "start_date").alias("day_number"))


def fn_month(s, d):
    return _shop(s, d).order_headers().select(
        "order_id", F.month("creation_time").cast("bigint").alias("month"))


def fn_iso_dow(s, d):
    return _shop(s, d).order_headers().select(
        "order_id", iso_dow("creation_time").alias("weekday_number"))


def fn_day_name(s, d):
    return _shop(s, d).order_headers().select(
        "order_id", day_name("creation_time").alias("weekday"))


def fn_concat_label(s, d):
    t = facts.reported(_shop(s, d).user_actions, td.campaigns())
    return t.select("order_id", label(CAMPAIGN_LABEL, "ads_campaign").alias("ads_campaign"))


def fn_round2(s, d):
    p = _shop(s, d).products
    return p.select("product_id", out_num(round2(F.col("price") * F.lit(Decimal("0.15"))))
                    .alias("discount"))


def fn_decimal_ratio(s, d):
    ca = _shop(s, d).courier_actions
    per = ca.groupBy("courier_id").agg(
        F.count(F.when(F.col("action") == "deliver_order", 1)).alias("delivered"),
        F.count(F.when(F.col("action") == "accept_order", 1)).alias("accepted"))
    return per.select("courier_id", out_num(ratio("delivered", "accepted")).alias("delivery_rate"))


def fn_case_else(s, d):
    return _shop(s, d).user_actions.select(
        "user_id", "order_id", F.expr(td.CAMPAIGN_RULE_SQL).alias("ads_campaign"))


def fn_case_null(s, d):
    model = td.cost_model()
    m = F.month("creation_time")
    expr = None
    for month, (fixed, *_rest) in sorted(model.tariffs.items()):
        val = F.lit(fixed).cast(MONEY_SUM)
        expr = F.when(m == month, val) if expr is None else expr.when(m == month, val)
    return _shop(s, d).order_headers().select("order_id", out_num(expr).alias("fixed_cost"))


def _day_deliveries(shop):
    cancelled = _cancelled(shop)
    return daily.star(daily.daily_revenue(facts.order_lines(shop, cancelled)),
                      daily.delivered_orders(shop.courier_actions, cancelled))


def fn_coalesce(s, d):
    t = _day_deliveries(_shop(s, d))
    return t.select("dt", F.coalesce("orders_delivered", F.lit(0)).cast("bigint")
                    .alias("orders_delivered"))


def fn_safe_divide(s, d):
    t = _day_deliveries(_shop(s, d))
    return t.select("dt", out_num(ratio("revenue", F.coalesce("orders_delivered", F.lit(0))))
                    .alias("revenue_per_delivery"))


def fn_explode(s, d):
    nested = td.order_fragments(s, d)
    return nested.select("order_id", F.explode("product_ids").alias("product_id"))


# -------------------------------------------------- 2.9 composite operators
def cancelled_orders(s, d):
    return facts.cancelled_orders(_shop(s, d).user_actions)


def valid_orders(s, d):
    shop = _shop(s, d)
    return facts.valid(shop.order_headers(), _cancelled(shop))


def cancel_flag(s, d):
    return facts.cancel_flag(_shop(s, d).user_actions)


def order_lines(s, d):
    return _dbl(_lines(_shop(s, d)), "price")


def campaign_tag(s, d):
    return facts.tag_campaign(_shop(s, d).user_actions, td.campaigns())


def campaign_order_lines(s, d):
    return _dbl(facts.campaign_order_lines(_shop(s, d), td.campaigns()), "price")


def daily_revenue(s, d):
    return _dbl(_daily(_shop(s, d)), "revenue")


def daily_orders_revenue(s, d):
    return _dbl(daily.daily_orders_revenue(_lines(_shop(s, d))), "revenue")


def daily_active_users(s, d):
    return daily.daily_active_users(_shop(s, d).user_actions)


def daily_paying_users(s, d):
    shop = _shop(s, d)
    return daily.daily_paying_users(shop.user_actions, _cancelled(shop))


def daily_new_users(s, d):
    return daily.daily_new_users(_shop(s, d).user_actions)


def daily_new_paying_users(s, d):
    shop = _shop(s, d)
    return daily.daily_new_paying_users(shop.user_actions, _cancelled(shop))


def order_price(s, d):
    return _dbl(daily.order_price(_lines(_shop(s, d))), "order_price")


def user_day_revenue(s, d):
    shop = _shop(s, d)
    cancelled = _cancelled(shop)
    prices = daily.order_price(facts.order_lines(shop, cancelled))
    return _dbl(daily.user_day_revenue(shop.user_actions, cancelled, prices), "revenue")


def first_day_revenue(s, d):
    shop = _shop(s, d)
    cancelled = _cancelled(shop)
    prices = daily.order_price(facts.order_lines(shop, cancelled))
    return _dbl(daily.first_day_revenue(shop.user_actions, prices, facts.hot_orders(shop)), "new_users_revenue")


def daily_delivered(s, d):
    shop = _shop(s, d)
    return daily.delivered_orders(shop.courier_actions, _cancelled(shop))


def daily_bonus_couriers(s, d):
    shop = _shop(s, d)
    return daily.bonus_couriers(shop.courier_actions, _cancelled(shop),
                                td.cost_model().bonus_min_orders)


def line_vat(s, d):
    return _dbl(_vat_lines(_shop(s, d)).select("order_id", "product_id", "name", "price", "tax"),
                "price", "tax")


def daily_costs(s, d):
    shop = _shop(s, d)
    cancelled = _cancelled(shop)
    model = td.cost_model()
    packed = facts.order_lines(shop, cancelled).groupBy(day("creation_time").alias("dt")).agg(
        F.count_distinct("order_id").alias("orders_packed"))
    t = daily.star(packed, daily.delivered_orders(shop.courier_actions, cancelled),
                   daily.bonus_couriers(shop.courier_actions, cancelled, model.bonus_min_orders))
    return t.select("dt", "orders_packed", "orders_delivered", "couriers_count",
                    out_num(costs.daily_costs(t, model)).alias("costs"))


def running_totals(s, d):
    t = _daily_rev_tax(_shop(s, d)).select("dt", "revenue", "tax")
    return _dbl(windows.running_totals(t, ["revenue", "tax"]),
                "revenue", "tax", "total_revenue", "total_tax")


def pct_change(s, d):
    return _daily(_shop(s, d)).select("dt", out_num(windows.pct_change("revenue"))
                                      .alias("revenue_change"))


def cohort_activity(s, d):
    return cohorts.cohort_activity(td.activity(s, d))


def retention(s, d):
    r = cohorts.retention(cohorts.cohort_activity(td.activity(s, d)))
    return _dbl(r, "retention")


def _name_revenue(shop):
    return _lines(shop).groupBy("name").agg(money_total("price").alias("revenue"))


def product_share(s, d):
    t = shares.share_of_total(_name_revenue(_shop(s, d)), "revenue", "share_in_revenue")
    return _dbl(t, "revenue", "share_in_revenue")


FOLD_BY_ID_THRESHOLD = Decimal("0.1")


def fold_small_groups(s, d):
    per = (_lines(_shop(s, d)).groupBy(F.col("product_id").cast("string").alias("product"))
           .agg(money_total("price").alias("revenue")))
    t = shares.share_of_total(per, "revenue", "share")
    f = shares.fold_small(t, "product", "revenue", "share", FOLD_BY_ID_THRESHOLD,
                          td.folding().label)
    return _dbl(f, "revenue", "share")


def user_avg_check(s, d):
    orders = facts.campaign_order_prices(_shop(s, d), td.campaigns(), window=td.FIRST_WEEK)
    per_order = orders.groupBy("ads_campaign", "user_id", "order_id").agg(
        money_total("order_price").alias("order_price"))
    per_user = per_order.groupBy("ads_campaign", "user_id").agg(
        ratio(money_total("order_price"), F.count("order_price")).alias("user_avg_check"))
    return _dbl(per_user, "user_avg_check")


QUERIES = {f.__name__: f for f in [
    scan_user_actions, scan_orders, scan_order_arrays, scan_products, scan_courier_actions,
    project_alias, project_qualified, filter_eq, filter_and, filter_in_list, filter_date_range,
    filter_ts_range, valid_orders_not_in, cancel_flag_filter,
    order_to_lines_left, lines_to_products_left, daily_star_left, weekday_star_left,
    first_day_revenue_join, cancelled_anti_join, campaign_totals_join,
    agg_sum, agg_sum_of_rounded, agg_count, agg_count_distinct, agg_mixed_distinct, agg_min,
    agg_max, agg_avg, agg_multi_key, agg_group_by_alias, agg_group_by_expr, agg_having,
    agg_two_level, agg_arith,
    win_filtered_count, win_min, win_min_two_keys, win_max_ratio, win_running_sum,
    win_running_sum_part, win_running_expr, win_running_ratio, win_grand_total, win_lag,
    win_row_number, line_running_revenue, user_running_revenue, previous_action, action_number,
    sort_asc, sort_desc, sort_alias_shadow,
    fn_to_date, fn_month_start, fn_day_number, fn_month, fn_iso_dow, fn_day_name,
    fn_concat_label, fn_round2, fn_decimal_ratio, fn_case_else, fn_case_null, fn_coalesce,
    fn_safe_divide, fn_explode,
    cancelled_orders, valid_orders, cancel_flag, order_lines, campaign_tag,
    campaign_order_lines, daily_revenue, daily_orders_revenue, daily_active_users,
    daily_paying_users, daily_new_users, daily_new_paying_users, order_price, user_day_revenue,
    first_day_revenue, daily_delivered, daily_bonus_couriers, line_vat, daily_costs,
    running_totals, pct_change, cohort_activity, retention, product_share, fold_small_groups,
    user_avg_check,
]}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    from orderlytics.plans.atoms_oracle import ORACLE
    return {k: o.with_roles(v) for k, v in ORACLE.items()}

