"""Hand-made micro tables with worked answers for the semantic rules of the
metrics (cancellation scope, bag semantics, clocks, NULL propagation,
rounding)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import micro_shop, rows, ts
from orderlytics.functions import percent, ratio
from orderlytics.plans import economics as E
from orderlytics.plans import marketing as M
from orderlytics.plans.registry import as_double
from orderlytics.sources.params import Campaigns, CostModel, Folding, VatRule

D = dt.date
C, X = "create_order", "cancel_order"


def campaigns(spark, members):
    m = spark.createDataFrame(members, "campaign_id INT, user_id BIGINT")
    return Campaigns(spend={1: Decimal("100.0"), 2: Decimal("100.0")}, members=m, label_prefix="C")


def test_bag_semantics_empty_null_arrays_unknown_product(spark):
    shop = micro_shop(
        spark,
        [(1, 1, C, ts(1)), (1, 2, C, ts(1)), (1, 3, C, ts(1)), (2, 4, C, ts(2)), (2, 5, C, ts(2))],
        [(1, ts(1), [5, 5]), (2, ts(1, 11), []), (3, ts(1, 12), None),
         (4, ts(2), [99]), (5, ts(2), [6])],
        [(5, "a", 10), (6, "b", 3.33)])
    got = rows(E.e1_daily_revenue(shop), "dt", "revenue", "total_revenue", "revenue_change")
    # the repeated product counts twice; the unknown product adds nothing
    assert got == [(D(2022, 9, 1), 20.0, 20.0, None), (D(2022, 9, 2), 3.33, 23.33, -83.35)]
    # orders without lines vanish from order counts (day 1: 20 / 1); an order whose only
    # product is unknown still counts (day 2: 3.33 / 2 = 1.665 -> 1.67)
    e2 = rows(E.e2_arpu_arppu_aov(shop), "dt", "aov")
    assert e2 == [(D(2022, 9, 1), 20.0), (D(2022, 9, 2), 1.67)]


def test_nested_and_normalised_order_lines_agree(spark):
    shop = micro_shop(spark, [(1, 1, C, ts(1)), (1, 2, C, ts(2))],
                      [(1, ts(1), [5, 5, 6]), (2, ts(2), None)], [(5, "a", 1), (6, "b", 2)])
    items = spark.createDataFrame([(1, 5), (1, 5), (1, 6)], "order_id BIGINT, product_id BIGINT")
    norm = type(shop)(shop.user_actions, shop.orders, shop.products, shop.courier_actions, items)
    assert rows(E.e1_daily_revenue(shop)) == rows(E.e1_daily_revenue(norm))


def test_m3_cancel_after_window_still_excludes(spark):
    shop = micro_shop(
        spark,
        [(1, 10, C, ts(3)), (1, 10, X, ts(10)),          # cancelled after the window
         (2, 11, C, ts(3)), (2, 12, C, ts(4)),
         (2, 13, C, ts(9))],                               # outside the window
        [(10, ts(3), [1]), (11, ts(3), [1]), (12, ts(4), [2]), (13, ts(9), [2])],
        [(1, "a", 10), (2, "b", 5.01)])
    c = campaigns(spark, [(1, 1), (1, 2)])
    got = rows(M.m3_avg_check(shop, c, (D(2022, 9, 1), D(2022, 9, 8))))
    # only user 2 counts: mean of 10.00 and 5.01 = 7.505 -> 7.51 (rounded twice)
    assert got == [("C1", 7.51)]


def test_m1_counts_any_action_and_m2_fans_out(spark):
    shop = micro_shop(
        spark,
        [(1, 1, C, ts(1)), (1, 1, "pay_order", ts(1)),   # two surviving rows for one order
         (2, 2, C, ts(1)), (2, 2, X, ts(1, 11)),          # cancelled: user 2 is no buyer
         (3, 3, C, ts(2))],
        [(1, ts(1), [7]), (2, ts(1), [7]), (3, ts(2), [7])],
        [(7, "x", 20)])
    c = campaigns(spark, [(1, 1), (1, 2), (2, 3), (2, 1)])   # user 1 in both: campaign 1 wins
    assert rows(M.m1_cac(shop, c)) == [("C1", 100.0), ("C2", 100.0)]
    # campaign 1 revenue: the order's line joined to both action rows = 40
    assert rows(M.m2_roi(shop, c)) == [("C1", -60.0), ("C2", -80.0)]


def test_m6_day_numbers_collapse_gaps_and_use_final_buyers(spark):
    shop = micro_shop(
        spark,
        [(1, 1, C, ts(1)), (2, 2, C, ts(3))],
        [(1, ts(1), [1]), (2, ts(3), [1])],
        [(1, "a", 30)])
    c = campaigns(spark, [(1, 1), (1, 2)])
    got = rows(M.m6_cumulative_arppu(shop, c), "day", "cumulative_arppu", "cac")
    assert got == [("Day 0", 15.0, 50.0), ("Day 1", 30.0, 50.0)]


def test_e5_first_day_cancelled_and_two_clocks(spark):
    shop = micro_shop(
        spark,
        [(1, 20, C, ts(1)), (1, 20, X, ts(1, 11)),       # user 1 starts on a cancelled order
         (1, 21, C, ts(2)),
         (2, 22, C, ts(1)),
         (3, 23, C, ts(2, 23, 59))],                      # action day 2, order created day 3
        [(20, ts(1), [1]), (21, ts(2), [1]), (22, ts(1), [2]), (23, ts(3, 0, 1), [2])],
        [(1, "a", 10), (2, "b", 5)])
    got = rows(E.e5_new_user_share(shop), "dt", "revenue", "new_users_revenue",
               "new_users_revenue_share", "old_users_revenue_share")
    assert got == [
        (D(2022, 9, 1), 5.0, 5.0, 100.0, 0.0),     # user 1 contributes 0, user 2 pays 5
        (D(2022, 9, 2), 10.0, 5.0, 50.0, 50.0),    # user 3 is new on day 2 by the action clock
        (D(2022, 9, 3), 5.0, None, None, None),
    ]


def test_e3_users_starting_without_revenue_are_lost(spark):
    shop = micro_shop(
        spark,
        [(1, 1, C, ts(1)), (1, 1, X, ts(1, 11)), (1, 2, C, ts(2)), (2, 3, C, ts(2))],
        [(1, ts(1), [1]), (2, ts(2), [1]), (3, ts(2), [1])],
        [(1, "a", 10)])
    got = rows(E.e3_running_arpu(shop))
    # day 2 revenue 20; new users on revenue days: user 2 only; new paying: both
    assert got == [(D(2022, 9, 2), 20.0, 10.0, 10.0)]


def test_e4_weekday_users_distinct_across_weeks(spark):
    # two Thursdays a week apart, the same user on both
    shop = micro_shop(
        spark,
        [(1, 1, C, ts(1)), (1, 2, C, ts(8))],
        [(1, ts(1), [1]), (2, ts(8), [1])],
        [(1, "a", 10)])
    got = rows(E.e4_weekday_arpu(shop, (D(2022, 9, 1), D(2022, 9, 9))))
    assert got == [("Thursday ", 4, 20.0, 20.0, 10.0)]


def test_e6_threshold_on_rounded_share_and_unknown_names(spark):
    shop = micro_shop(
        spark,
        [(1, 1, C, ts(1))],
        [(1, ts(1), [1, 2, 3, 99])],
        [(1, "big", 994.96), (2, "small", 5.0), (3, "tiny", 0.04)])
    got = rows(E.e6_product_share(shop, Folding(threshold=Decimal("0.5"), label="OTHER")))
    # small: 0.5004% rounds to 0.50 -> kept; tiny: 0.004% -> folded
    assert got == [("OTHER", 0.04, 0.0), ("big", 994.96, 99.5), ("small", 5.0, 0.5)]


def test_e7_vat_per_line_month_without_tariff_and_delivery_only_days(spark):
    shop = micro_shop(
        spark,
        [(1, 1, C, ts(31, month=8)), (1, 2, C, ts(1, month=7)), (1, 3, C, ts(1))],
        [(1, ts(31, month=8), [1, 1]), (2, ts(1, month=7), [1]), (3, ts(1), [2])],
        [(1, "reduced", 0.55), (2, "other", 1.0)],
        [(7, 1, "deliver_order", ts(31, 12, month=8)),
         (7, 9, "deliver_order", ts(5, month=7))])     # a day without revenue: dropped
    vat = VatRule(reduced=["reduced"])
    got = {r["dt"]: r for r in as_double(E.e7_gross_profit(shop, vat, CostModel())).collect()}
    assert set(got) == {D(2022, 7, 1), D(2022, 8, 31), D(2022, 9, 1)}
    aug = got[D(2022, 8, 31)]
    assert aug["tax"] == 0.1          # 0.05 per line (0.55 * 10 / 110), rounded per line
    assert aug["costs"] == 120000.0 + 140 + 150
    jul = got[D(2022, 7, 1)]
    assert jul["costs"] is None and jul["gross_profit"] is None
    sep = got[D(2022, 9, 1)]
    assert sep["tax"] == 0.17         # 1.00 * 20 / 120 = 0.1667
    # July's NULL gross profit is skipped by the running sum
    assert sep["total_gross_profit"] == round(aug["gross_profit"] + sep["gross_profit"], 2)


def test_retention_without_day_zero_uses_cohort_size(spark):
    shop = micro_shop(
        spark,
        [(1, None, "open", ts(1)), (2, None, "open", ts(1)), (1, None, "open", ts(2)),
         (2, None, "open", ts(8)), (1, None, "open", ts(8))],
        [], [])
    c = campaigns(spark, [(1, 1), (1, 2)])
    got = rows(M.m5_campaign_retention(shop, c, days=(1, 7)), "day_number", "retention")
    assert got == [(1, 0.5), (7, 1.0)]
    m4 = rows(M.m4_retention(shop), "start_month", "day_number", "retention")
    assert m4 == [(D(2022, 9, 1), 0, 1.0), (D(2022, 9, 1), 1, 0.5), (D(2022, 9, 1), 7, 1.0)]


def test_rounding_ties_and_zero_denominators(spark):
    df = spark.createDataFrame(
        [(Decimal("201"), Decimal("200")), (Decimal("-125"), Decimal("1000")),
         (Decimal("1"), Decimal("0"))], "n DECIMAL(10,0), d DECIMAL(10,0)")
    got = [tuple(r) for r in df.select(ratio("n", "d").cast("double"),
                                      percent("n", "d").cast("double")).collect()]
    assert got == [(1.01, 100.5), (-0.13, -12.5), (None, None)]


def test_cancel_rows_without_order_id_are_ignored(spark):
    shop = micro_shop(
        spark,
        [(1, 1, C, ts(1)), (1, None, X, ts(1))],
        [(1, ts(1), [1])], [(1, "a", 2)])
    assert rows(E.e1_daily_revenue(shop), "revenue") == [(2.0,)]


def test_day_name_and_iso_dow(spark):
    from orderlytics.functions import day_name, iso_dow
    df = spark.createDataFrame([(ts(4),)], "t TIMESTAMP_NTZ")   # a Sunday
    r = df.select(day_name("t").alias("a"), day_name("t", padded=False).alias("b"),
                  iso_dow("t").alias("c"), F.lit(1).alias("z")).first()
    assert (r.a, r.b, r.c) == ("Sunday   ", "Sunday", 7)


def test_actions_without_order_id(spark):
    shop = micro_shop(
        spark,
        [(1, None, "open_app", ts(1)), (2, 1, C, ts(1))],
        [(1, ts(1), [1])], [(1, "a", 10)])
    # the window cancel flag keeps an action without order: user 1 counts for CAC
    c = campaigns(spark, [(1, 1), (1, 2)])
    assert rows(M.m1_cac(shop, c)) == [("C1", 50.0)]
    # ... and is an active user but not a paying one (NOT IN drops a NULL id)
    assert rows(E.e2_arpu_arppu_aov(shop)) == [(D(2022, 9, 1), 5.0, 10.0, 10.0)]


def test_free_product_alone_on_a_day(spark):
    shop = micro_shop(
        spark,
        [(1, 1, C, ts(1)), (1, 2, C, ts(2))],
        [(1, ts(1), [1]), (2, ts(2), [2])],
        [(1, "free", 0), (2, "paid", 4)])
    e1 = rows(E.e1_daily_revenue(shop), "dt", "revenue", "revenue_change")
    # day 2 grows from 0: the change has a zero denominator -> NULL, not an error
    assert e1 == [(D(2022, 9, 1), 0.0, None), (D(2022, 9, 2), 4.0, None)]
    e7 = {r["dt"]: r for r in E.e7_gross_profit(shop, VatRule(reduced=[]), CostModel()).collect()}
    assert e7[D(2022, 9, 1)]["gross_profit_ratio"] is None


def test_shop_reads_canonical_parquet_folders(spark, tmp_path):
    from orderlytics.sources.tables import Shop
    shop = micro_shop(
        spark,
        [(1, 1, C, ts(1)), (1, 2, C, ts(2)), (1, 2, X, ts(2, 11))],
        [(1, ts(1), [1, 1]), (2, ts(2), [1])],
        [(1, "a", 2.5)],
        [(3, 1, "deliver_order", ts(1, 12))])
    root = str(tmp_path)
    shop.write_parquet(root)
    back = Shop.read_parquet(root, spark)
    assert rows(E.e1_daily_revenue(back)) == rows(E.e1_daily_revenue(shop))
    assert rows(E.e7_gross_profit(back, VatRule(reduced=[]), CostModel())) == \
        rows(E.e7_gross_profit(shop, VatRule(reduced=[]), CostModel()))


def test_duplicated_order_rows_with_and_without_lines(spark):
    shop = micro_shop(spark, [(1, 1, C, ts(1)), (1, 2, C, ts(1))],
                      [(1, ts(1), [5]), (1, ts(1), [5]), (2, ts(1), None), (2, ts(1), None)],
                      [(5, "a", 3)])
    items = spark.createDataFrame([(1, 5)], "order_id BIGINT, product_id BIGINT")
    headers = shop.orders.select("order_id", "creation_time")
    norm = type(shop)(shop.user_actions, headers, shop.products, shop.courier_actions, items)
    c = campaigns(spark, [(1, 1)])
    from orderlytics.operators import facts
    for s in (shop, norm):
        got = rows(facts.campaign_order_lines(s, c), "order_id", "product_id", "price")
        # order 1 is listed twice: its line twice; order 2 (twice, no lines): one NULL row
        assert got == [(1, 5, 3), (1, 5, 3), (2, None, None)], got


def test_odd_orders_as_arrays_and_as_items(spark):
    """Orders listed twice, without lines, with an empty array beside a full one, of missing
    products and without id: E5 and the lines of campaign users are the same in both forms."""
    from orderlytics.operators import facts
    shop = micro_shop(
        spark,
        [(1, 1, C, ts(1)), (1, 1, "pay_order", ts(1)), (2, 2, C, ts(1)), (3, 3, C, ts(2)), (3, 4, C, ts(2)),
         (4, 5, C, ts(2)), (4, 5, X, ts(2, 11)), (5, None, C, ts(3)), (None, 6, C, ts(3)), (6, 9, C, ts(3))],
        [(1, ts(1), [7, 8]), (1, ts(2), [7, 8]), (2, ts(1), None), (3, ts(2), []), (3, ts(2), [8, None, 99]),
         (4, ts(2), []), (5, ts(2), [7]), (6, ts(3), [7]), (None, ts(3), [7])],
        [(7, "x", 20), (8, "y", 5)])
    norm = type(shop)(shop.user_actions, shop.orders.select("order_id", "creation_time"), shop.products,
                      shop.courier_actions, spark.createDataFrame(
                          [(1, 7), (1, 8), (5, 7), (6, 7), (None, 7)], "order_id BIGINT, product_id BIGINT"))
    one = shop.orders.filter("order_id IS NULL OR order_id <> 3")     # as items, order 3 would be listed twice
    c = campaigns(spark, [(1, u) for u in range(1, 7)])
    got = rows(facts.campaign_order_lines(shop, c), "user_id", "order_id", "product_id", "price")
    assert got == sorted(
        [(1, 1, 7, 20.0), (1, 1, 8, 5.0)] * 4 + [(2, 2, None, None), (3, 3, 8, 5.0), (3, 3, None, None), (3, 3, 99, None),
                                                  (3, 4, None, None), (5, None, None, None), (6, 9, None, None)],
        key=lambda t: tuple((x is None, str(x)) for x in t))
    nested = type(shop)(shop.user_actions, one, shop.products, shop.courier_actions)
    want = [(D(2022, 9, 1), 25.0, 100.0, 400.0, -300.0), (D(2022, 9, 2), 25.0, 0.0, 0.0, 100.0),
            (D(2022, 9, 3), 20.0, 0.0, 0.0, 100.0)]
    for s in (nested, norm):
        assert rows(E.e5_new_user_share(s), "dt", "revenue", "new_users_revenue", "new_users_revenue_share",
                    "old_users_revenue_share") == want
