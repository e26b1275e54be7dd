"""DuckDB oracle bodies for the operator-level queries of ``plans.atoms``
(the shared role CTEs of ``oracle.PREFIX`` are added by ``oracle.with_roles``)."""

from __future__ import annotations

from orderlytics.plans import atoms
from orderlytics.plans.oracle import (CAMPAIGN, COHORT_DAYS, DELIVERIES, FIRST_SEEN, FIRST_WEEK_WHERE, LABEL,
                                      NOT_CANCELLED, ORDER_VALUE, OTHER, SALES_BY_DAY,
                                      SPEND_BY_USER_DAY, USER_CHECKS, VAT_LINES, _tariff_case,
                                      _W0, _W1, cents, dbl_cents, r2, r2k)
from orderlytics.sources import testdata as td

DAILY = "(SELECT CAST(creation_time AS DATE) AS dt, SUM(price) AS revenue FROM valid_lines GROUP BY 1)"
DAILY_VAT = f"""(SELECT CAST(creation_time AS DATE) AS dt, COUNT(DISTINCT order_id) AS orders,
                        SUM(price_c) AS revenue_c, SUM(tax_c) AS tax_c
                 FROM ({VAT_LINES}) v GROUP BY 1)"""
PER_COURIER_DAY = f"""(SELECT dt, courier_id, COUNT(DISTINCT order_id) AS orders_delivered
                       FROM ({DELIVERIES}) d GROUP BY dt, courier_id)"""
DELIVERED = f"""(SELECT dt, COUNT(DISTINCT order_id) AS orders_delivered
                 FROM ({DELIVERIES}) d GROUP BY dt)"""
BONUS = f"""(SELECT dt, COUNT(courier_id) AS couriers_count FROM {PER_COURIER_DAY} pc
             WHERE orders_delivered >= {td.cost_model().bonus_min_orders} GROUP BY dt)"""
CAMPAIGN_DAYS = """(SELECT ads_campaign, CAST("time" AS DATE) AS dt, SUM(price) AS revenue
                    FROM campaign_lines GROUP BY 1, 2)"""
COHORTS = f"({COHORT_DAYS})"
CANCEL_COUNT = "COUNT(CASE WHEN action = 'cancel_order' THEN 1 END) OVER (PARTITION BY order_id)"
BY_DAY = "WINDOW by_day AS (ORDER BY dt ASC NULLS LAST)"
WEEKDAY = "rpad(dayname({}), 9, ' ')"
FOLD_K = int(atoms.FOLD_BY_ID_THRESHOLD * 100)
SHARE_K = r2k(f"100 * {cents('revenue')}", cents("SUM(revenue) OVER ()"))

ORACLE = {
    # scans
    "scan_user_actions": 'SELECT user_id, order_id, action, "time" FROM ua',
    "scan_orders": """SELECT order_id, creation_time, CAST(len(product_ids) AS BIGINT) AS n_items,
                             CAST(list_sum(product_ids) AS BIGINT) AS items_sum FROM ord""",
    "scan_order_arrays": """
        SELECT order_id, CAST((n - 1) // 64 AS BIGINT) AS part, COUNT(*) AS n_items,
               string_agg(COALESCE(CAST(product_id AS VARCHAR), '-'), ',' ORDER BY n) AS product_ids
        FROM (SELECT l_orderkey AS order_id, l_partkey AS product_id,
                     row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey ASC NULLS LAST) AS n
              FROM lineitem) numbered
        GROUP BY 1, 2""",
    "scan_products": "SELECT product_id, name, CAST(price AS DOUBLE) AS price FROM prod",
    "scan_courier_actions": 'SELECT courier_id, order_id, action, "time" FROM ca',
    # projection, filters
    "project_alias": "SELECT order_id AS id, CAST(creation_time AS DATE) AS dt FROM ord",
    "project_qualified": f"""
        SELECT o.weekday AS weekday, o.weekday_number AS weekday_number, o.orders AS orders,
               u.users AS users
        FROM (SELECT {WEEKDAY.format('creation_time')} AS weekday,
                     MAX(isodow(creation_time)) AS weekday_number, COUNT(order_id) AS orders
              FROM ord GROUP BY 1) o
        LEFT JOIN (SELECT {WEEKDAY.format('"time"')} AS weekday,
                          MAX(isodow("time")) AS weekday_number, COUNT(DISTINCT user_id) AS users
                   FROM ua GROUP BY 1) u ON o.weekday = u.weekday""",
    "filter_eq": """SELECT user_id, order_id, "time" FROM ua WHERE action = 'cancel_order'""",
    "filter_and": f"""SELECT ads_campaign, user_id, order_id FROM flagged_actions
                      WHERE ads_campaign IN (1, 2) AND cancel_rows = 0 AND {FIRST_WEEK_WHERE}""",
    "filter_in_list": f"""
        SELECT user_id, order_id, ads_campaign
        FROM (SELECT user_id, order_id, {CAMPAIGN} AS ads_campaign FROM ua) tagged
        WHERE ads_campaign IN (1, 2)""",
    "filter_date_range": f'SELECT user_id, order_id, "time" FROM ua WHERE {FIRST_WEEK_WHERE}',
    "filter_ts_range": f"""SELECT order_id, creation_time FROM ord
                           WHERE creation_time >= {_W0} AND creation_time < {_W1}""",
    "valid_orders_not_in": f'SELECT user_id, order_id, action, "time" FROM ua WHERE {NOT_CANCELLED}',
    "cancel_flag_filter": f"""
        SELECT user_id, order_id, action, "time"
        FROM (SELECT *, {CANCEL_COUNT} AS n_cancel FROM ua) f WHERE n_cancel = 0""",
    # joins
    "order_to_lines_left": """
        SELECT ads_campaign, user_id, order_id, product_id
        FROM (SELECT ads_campaign, user_id, order_id FROM flagged_actions
              WHERE ads_campaign IN (1, 2) AND cancel_rows = 0) buyers
        LEFT JOIN all_items USING (order_id)""",
    "lines_to_products_left": """
        SELECT order_id, product_id, name, CAST(price AS DOUBLE) AS price
        FROM all_items LEFT JOIN prod USING (product_id)""",
    "daily_star_left": f"""
        SELECT dt, orders, CAST(revenue AS DOUBLE) AS revenue, users, paying_users
        FROM ({SALES_BY_DAY}) s
        LEFT JOIN (SELECT CAST("time" AS DATE) AS dt, COUNT(DISTINCT user_id) AS users
                   FROM ua GROUP BY 1) v USING (dt)
        LEFT JOIN (SELECT CAST("time" AS DATE) AS dt, COUNT(DISTINCT user_id) AS paying_users
                   FROM ua WHERE {NOT_CANCELLED} GROUP BY 1) p USING (dt)""",
    "weekday_star_left": f"""
        SELECT weekday, weekday_number, orders, CAST(revenue AS DOUBLE) AS revenue, users,
               paying_users
        FROM (SELECT {WEEKDAY.format('creation_time')} AS weekday,
                     MAX(isodow(creation_time)) AS weekday_number,
                     COUNT(DISTINCT order_id) AS orders, SUM(price) AS revenue
              FROM valid_lines GROUP BY 1) s
        LEFT JOIN (SELECT {WEEKDAY.format('"time"')} AS weekday, COUNT(DISTINCT user_id) AS users
                   FROM ua GROUP BY 1) v USING (weekday)
        LEFT JOIN (SELECT {WEEKDAY.format('"time"')} AS weekday,
                          COUNT(DISTINCT user_id) AS paying_users
                   FROM ua WHERE {NOT_CANCELLED} GROUP BY 1) p USING (weekday)""",
    "first_day_revenue_join": f"""
        SELECT f.user_id AS user_id, f.start_date AS start_date,
               CAST(COALESCE(s.revenue, 0) AS DOUBLE) AS revenue
        FROM ({FIRST_SEEN}) f LEFT JOIN ({SPEND_BY_USER_DAY}) s
          ON s.user_id = f.user_id AND s.dt = f.start_date""",
    "cancelled_anti_join": f'SELECT courier_id, order_id, action, "time" FROM ca WHERE {NOT_CANCELLED}',
    "campaign_totals_join": f"""
        SELECT ads_campaign, dt, CAST(revenue AS DOUBLE) AS revenue, paying_users
        FROM {CAMPAIGN_DAYS} d
        LEFT JOIN (SELECT ads_campaign, COUNT(DISTINCT user_id) AS paying_users
                   FROM campaign_lines GROUP BY 1) b USING (ads_campaign)""",
    # aggregates
    "agg_sum": "SELECT product_id, CAST(SUM(price) AS DOUBLE) AS revenue FROM valid_lines GROUP BY 1",
    "agg_sum_of_rounded": f"""SELECT CAST(creation_time AS DATE) AS dt, {dbl_cents('SUM(tax_c)')} AS tax
                              FROM ({VAT_LINES}) v GROUP BY 1""",
    "agg_count": f"""SELECT order_id, COUNT(product_id) AS n_lines
                     FROM (SELECT order_id, UNNEST(product_ids) AS product_id FROM ord
                           WHERE {NOT_CANCELLED}) i
                     GROUP BY order_id""",
    "agg_count_distinct": "SELECT courier_id, COUNT(DISTINCT order_id) AS orders FROM ca GROUP BY 1",
    "agg_mixed_distinct": """
        SELECT CAST(date_trunc('month', CAST(creation_time AS DATE)) AS DATE) AS month,
               COUNT(DISTINCT order_id) AS orders, CAST(SUM(price) AS DOUBLE) AS revenue
        FROM valid_lines GROUP BY 1""",
    "agg_min": FIRST_SEEN,
    "agg_max": f"""SELECT {WEEKDAY.format('creation_time')} AS weekday,
                          MAX(isodow(creation_time)) AS weekday_number FROM ord GROUP BY 1""",
    "agg_avg": f"""SELECT name, {r2(f"SUM({cents('price')})", '100 * COUNT(price)')} AS avg_price
                   FROM prod GROUP BY name""",
    "agg_multi_key": f"SELECT dt, courier_id, orders_delivered FROM {PER_COURIER_DAY} pc",
    "agg_group_by_alias": """SELECT CAST(creation_time AS DATE) AS dt, COUNT(order_id) AS orders
                             FROM ord GROUP BY dt""",
    "agg_group_by_expr": """SELECT CAST("time" AS DATE) AS dt, COUNT(*) AS actions
                            FROM ua GROUP BY CAST("time" AS DATE)""",
    "agg_having": f"""
        SELECT dt, courier_id, COUNT(DISTINCT order_id) AS orders_delivered
        FROM ({DELIVERIES}) d GROUP BY dt, courier_id
        HAVING COUNT(DISTINCT order_id) >= {td.cost_model().bonus_min_orders}""",
    "agg_two_level": f"SELECT dt, COUNT(courier_id) AS couriers FROM {PER_COURIER_DAY} pc GROUP BY dt",
    "agg_arith": f"""SELECT CAST(creation_time AS DATE) AS dt,
                            {dbl_cents('SUM(price_c) - SUM(tax_c)')} AS net_revenue
                     FROM ({VAT_LINES}) v GROUP BY 1""",
    # windows
    "win_filtered_count": """
        SELECT courier_id, order_id, action, "time",
               COUNT(CASE WHEN action = 'deliver_order' THEN 1 END)
                   OVER (PARTITION BY order_id) AS n_deliveries
        FROM ca""",
    "win_min": """SELECT user_id, CAST("time" AS DATE) AS dt,
                         MIN(CAST("time" AS DATE)) OVER (PARTITION BY user_id) AS start_date
                  FROM ua""",
    "win_min_two_keys": f"""
        SELECT ads_campaign, user_id, dt,
               MIN(dt) OVER (PARTITION BY ads_campaign, user_id) AS start_date
        FROM (SELECT user_id, CAST("time" AS DATE) AS dt, {CAMPAIGN} AS ads_campaign FROM act) a
        WHERE ads_campaign IN (1, 2)""",
    "win_max_ratio": f"""
        SELECT dt, courier_id,
               {r2('orders_delivered', 'MAX(orders_delivered) OVER (PARTITION BY dt)')} AS of_best
        FROM {PER_COURIER_DAY} pc""",
    "win_running_sum": f"""SELECT dt, CAST(SUM(revenue) OVER by_day AS DOUBLE) AS total_revenue
                           FROM {DAILY} d {BY_DAY}""",
    "win_running_sum_part": f"""
        SELECT ads_campaign, dt,
               CAST(SUM(revenue) OVER (PARTITION BY ads_campaign ORDER BY dt ASC NULLS LAST)
                    AS DOUBLE) AS running_revenue
        FROM {CAMPAIGN_DAYS} d""",
    "win_running_expr": f"""SELECT dt, {dbl_cents('SUM(revenue_c - tax_c) OVER by_day')} AS running_net
                            FROM {DAILY_VAT} d {BY_DAY}""",
    "win_running_ratio": f"""
        SELECT dt, {r2('SUM(revenue_c) OVER by_day', '100 * SUM(orders) OVER by_day')} AS running_aov
        FROM {DAILY_VAT} d {BY_DAY}""",
    "win_grand_total": f"""SELECT dt, CAST(revenue AS DOUBLE) AS revenue, {dbl_cents(SHARE_K)} AS share
                           FROM {DAILY} d""",
    "win_lag": f"""SELECT dt, CAST(revenue AS DOUBLE) AS revenue,
                          CAST(LAG(revenue, 1) OVER by_day AS DOUBLE) AS prev_revenue
                   FROM {DAILY} d {BY_DAY}""",
    "win_row_number": f"""
        SELECT ads_campaign, dt,
               row_number() OVER (PARTITION BY ads_campaign ORDER BY dt ASC NULLS LAST) AS day_number
        FROM {CAMPAIGN_DAYS} d""",
    # windows over raw rows
    "line_running_revenue": """
        SELECT order_id, product_id, creation_time, CAST(price AS DOUBLE) AS price,
               CAST(SUM(price) OVER (ORDER BY creation_time ASC NULLS LAST) AS DOUBLE) AS total_price
        FROM valid_lines""",
    "user_running_revenue": """
        SELECT user_id, "time", order_id, CAST(price AS DOUBLE) AS price,
               CAST(SUM(price) OVER (PARTITION BY user_id ORDER BY "time" ASC NULLS LAST) AS DOUBLE) AS total_price
        FROM campaign_lines""",
    "previous_action": """
        SELECT user_id, "time", order_id, action,
               LAG("time", 1) OVER (PARTITION BY user_id ORDER BY "time" ASC NULLS LAST, order_id ASC NULLS LAST,
                                    action ASC NULLS LAST) AS previous_time
        FROM ua""",
    "action_number": """
        SELECT user_id, "time", order_id, action,
               row_number() OVER (ORDER BY "time" ASC NULLS LAST, user_id ASC NULLS LAST, order_id ASC NULLS LAST,
                                  action ASC NULLS LAST) AS number
        FROM ua""",
    # sorts
    "sort_asc": f"SELECT dt, CAST(revenue AS DOUBLE) AS revenue FROM {DAILY} d ORDER BY dt ASC NULLS LAST",
    "sort_desc": """SELECT name, CAST(SUM(price) AS DOUBLE) AS revenue FROM valid_lines
                    GROUP BY name ORDER BY revenue DESC NULLS FIRST""",
    "sort_alias_shadow": """SELECT name, CAST(SUM(price) AS DOUBLE) AS price FROM valid_lines
                            GROUP BY name ORDER BY price DESC NULLS FIRST""",
    # scalar functions
    "fn_to_date": 'SELECT user_id, CAST("time" AS DATE) AS dt FROM ua',
    "fn_month_start": """SELECT order_id, CAST(date_trunc('month', CAST("time" AS DATE)) AS DATE)
                                AS month FROM ua""",
    "fn_day_number": """
        SELECT user_id, order_id,
               CAST(CAST("time" AS DATE) - MIN(CAST("time" AS DATE)) OVER (PARTITION BY user_id)
                    AS BIGINT) AS day_number
        FROM ua""",
    "fn_month": "SELECT order_id, month(creation_time) AS month FROM ord",
    "fn_iso_dow": "SELECT order_id, isodow(creation_time) AS weekday_number FROM ord",
    "fn_day_name": f"SELECT order_id, {WEEKDAY.format('creation_time')} AS weekday FROM ord",
    "fn_concat_label": f"""
        SELECT order_id, CONCAT({LABEL}, ads_campaign) AS ads_campaign
        FROM (SELECT order_id, {CAMPAIGN} AS ads_campaign FROM ua) tagged
        WHERE ads_campaign IN (1, 2)""",
    "fn_round2": f"SELECT product_id, {r2(cents('price') + ' * 15', '10000')} AS discount FROM prod",
    "fn_decimal_ratio": f"""
        SELECT courier_id,
               {r2("COUNT(CASE WHEN action = 'deliver_order' THEN 1 END)",
                   "COUNT(CASE WHEN action = 'accept_order' THEN 1 END)")} AS delivery_rate
        FROM ca GROUP BY courier_id""",
    "fn_case_else": f"SELECT user_id, order_id, {CAMPAIGN} AS ads_campaign FROM ua",
    "fn_case_null": """
        SELECT order_id,
               CAST(CASE WHEN month(creation_time) = 8 THEN 120000.0
                         WHEN month(creation_time) = 9 THEN 150000.0 END AS DOUBLE) AS fixed_cost
        FROM ord""",
    "fn_coalesce": f"""SELECT dt, COALESCE(orders_delivered, 0) AS orders_delivered
                       FROM {DAILY} d LEFT JOIN {DELIVERED} x USING (dt)""",
    "fn_safe_divide": f"""
        SELECT dt, {r2(cents('revenue'), '100 * COALESCE(orders_delivered, 0)')} AS revenue_per_delivery
        FROM {DAILY} d LEFT JOIN {DELIVERED} x USING (dt)""",
    "fn_explode": "SELECT order_id, product_id FROM all_items",
    # composite operators
    "cancelled_orders": "SELECT DISTINCT order_id FROM cancelled",
    "valid_orders": f"SELECT order_id, creation_time FROM ord WHERE {NOT_CANCELLED}",
    "cancel_flag": f'SELECT user_id, order_id, action, "time", {CANCEL_COUNT} AS is_canceled FROM ua',
    "order_lines": """SELECT order_id, creation_time, product_id, name,
                             CAST(price AS DOUBLE) AS price FROM valid_lines""",
    "campaign_tag": f"""SELECT user_id, order_id, action, "time", {CAMPAIGN} AS ads_campaign FROM ua""",
    "campaign_order_lines": """
        SELECT ads_campaign, user_id, order_id, "time", product_id, CAST(price AS DOUBLE) AS price
        FROM campaign_lines""",
    "daily_revenue": f"SELECT dt, CAST(revenue AS DOUBLE) AS revenue FROM {DAILY} d",
    "daily_orders_revenue": f"""SELECT dt, orders, CAST(revenue AS DOUBLE) AS revenue
                                FROM ({SALES_BY_DAY}) s""",
    "daily_active_users": """SELECT CAST("time" AS DATE) AS dt, COUNT(DISTINCT user_id) AS users
                             FROM ua GROUP BY 1""",
    "daily_paying_users": f"""
        SELECT CAST("time" AS DATE) AS dt, COUNT(DISTINCT user_id) AS paying_users
        FROM ua WHERE {NOT_CANCELLED} GROUP BY 1""",
    "daily_new_users": f"""SELECT start_date AS dt, COUNT(user_id) AS new_users
                           FROM ({FIRST_SEEN}) f GROUP BY start_date""",
    "daily_new_paying_users": f"""
        SELECT dt, COUNT(user_id) AS new_paying_users
        FROM (SELECT user_id, MIN(CAST("time" AS DATE)) AS dt FROM ua WHERE {NOT_CANCELLED}
              GROUP BY user_id) f
        GROUP BY dt""",
    "order_price": f"""SELECT order_id, CAST(order_price AS DOUBLE) AS order_price
                       FROM ({ORDER_VALUE}) v""",
    "user_day_revenue": f"""SELECT user_id, dt, CAST(revenue AS DOUBLE) AS revenue
                            FROM ({SPEND_BY_USER_DAY}) s""",
    "first_day_revenue": f"""
        SELECT f.start_date AS dt, CAST(SUM(COALESCE(s.revenue, 0)) AS DOUBLE) AS new_users_revenue
        FROM ({FIRST_SEEN}) f LEFT JOIN ({SPEND_BY_USER_DAY}) s
          ON s.user_id = f.user_id AND s.dt = f.start_date
        GROUP BY f.start_date""",
    "daily_delivered": f"SELECT dt, orders_delivered FROM {DELIVERED} x",
    "daily_bonus_couriers": f"SELECT dt, couriers_count FROM {BONUS} b",
    "line_vat": f"""SELECT order_id, product_id, name, CAST(price AS DOUBLE) AS price,
                           {dbl_cents('tax_c')} AS tax FROM ({VAT_LINES}) v""",
    "daily_costs": f"""
        SELECT dt, orders_packed, orders_delivered, couriers_count,
               {dbl_cents(_tariff_case('dt'))} AS costs
        FROM (SELECT CAST(creation_time AS DATE) AS dt, COUNT(DISTINCT order_id) AS orders_packed
              FROM valid_lines GROUP BY 1) pk
        LEFT JOIN {DELIVERED} x USING (dt)
        LEFT JOIN {BONUS} b USING (dt)""",
    "running_totals": f"""
        SELECT dt, {dbl_cents('revenue_c')} AS revenue, {dbl_cents('tax_c')} AS tax,
               {dbl_cents('SUM(revenue_c) OVER by_day')} AS total_revenue,
               {dbl_cents('SUM(tax_c) OVER by_day')} AS total_tax
        FROM {DAILY_VAT} d {BY_DAY}""",
    "pct_change": f"""
        SELECT dt, {r2(f"100 * ({cents('revenue')} - {cents('prev')})", cents('prev'))}
                   AS revenue_change
        FROM (SELECT dt, revenue, LAG(revenue, 1) OVER by_day AS prev FROM {DAILY} d {BY_DAY}) x""",
    "cohort_activity": f"SELECT start_date, dt, users FROM {COHORTS} c",
    "retention": f"""
        SELECT start_date, CAST(dt - start_date AS BIGINT) AS day_number, users,
               {r2('users', 'MAX(users) OVER (PARTITION BY start_date)')} AS retention
        FROM {COHORTS} c""",
    "product_share": f"""
        SELECT name, CAST(revenue AS DOUBLE) AS revenue, {dbl_cents(SHARE_K)} AS share_in_revenue
        FROM (SELECT name, SUM(price) AS revenue FROM valid_lines GROUP BY name) r""",
    "fold_small_groups": f"""
        SELECT CASE WHEN share_k >= {FOLD_K} THEN product ELSE {OTHER} END AS product,
               CAST(SUM(revenue) AS DOUBLE) AS revenue, {dbl_cents('SUM(share_k)')} AS share
        FROM (SELECT product, revenue, {SHARE_K} AS share_k
              FROM (SELECT CAST(product_id AS VARCHAR) AS product, SUM(price) AS revenue
                    FROM valid_lines GROUP BY 1) r) s
        GROUP BY 1""",
    "user_avg_check": f"""SELECT ads_campaign, user_id, {dbl_cents('check_k')} AS user_avg_check
                          FROM ({USER_CHECKS}) u""",
}
