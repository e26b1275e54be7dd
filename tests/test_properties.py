"""Properties that must hold on any data, checked on the test tables."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from orderlytics.operators import facts
from orderlytics.plans import economics as E
from orderlytics.plans import marketing as M
from orderlytics.sources import testdata as td

METRICS = {
    "e1": lambda s: E.e1_daily_revenue(s),
    "e2": lambda s: E.e2_arpu_arppu_aov(s),
    "e3": lambda s: E.e3_running_arpu(s),
    "e4": lambda s: E.e4_weekday_arpu(s, td.WEEKDAY_WINDOW),
    "e5": lambda s: E.e5_new_user_share(s),
    "e6": lambda s: E.e6_product_share(s, td.folding()),
    "e7": lambda s: E.e7_gross_profit(s, td.vat_rule(), td.cost_model()),
    "m2": lambda s: M.m2_roi(s, td.campaigns()),
    "m3": lambda s: M.m3_avg_check(s, td.campaigns(), td.FIRST_WEEK),
    "m6": lambda s: M.m6_cumulative_arppu(s, td.campaigns()),
}


@pytest.fixture(scope="module")
def shop(spark):
    return td.shop(spark, SF_SMALL)


@pytest.mark.parametrize("name", sorted(METRICS))
def test_nested_orders_equal_normalised_items(spark, shop, name):
    nested = td.shop(spark, SF_SMALL, normalised=False)
    assert rows(METRICS[name](nested)) == rows(METRICS[name](shop))


def test_retention_bounds(spark):
    r = M.m4_retention(td.activity_shop(spark, SF_SMALL))
    day0 = r.filter("day_number = 0").select("retention").distinct().collect()
    assert [x[0] for x in day0] == [1.0]
    assert r.filter("retention > 1 OR retention <= 0").count() == 0


def test_running_total_ends_at_the_sum(shop):
    e1 = E.e1_daily_revenue(shop)
    last = e1.orderBy(F.col("dt").desc()).first()["total_revenue"]
    total = facts.order_lines(shop).agg(F.sum("price")).first()[0]
    assert Decimal(str(last)) == total


def test_new_and_old_shares_add_to_100(shop):
    e5 = E.e5_new_user_share(shop).filter("new_users_revenue_share IS NOT NULL")
    assert e5.count() > 0
    bad = e5.filter(F.abs(F.col("new_users_revenue_share") + F.col("old_users_revenue_share")
                          - 100) > 1e-9)
    assert bad.count() == 0


def test_folding_keeps_total_revenue(shop):
    folded = E.e6_product_share(shop, td.folding()).agg(F.sum("revenue")).first()[0]
    total = facts.order_lines(shop).agg(F.sum("price")).first()[0]
    assert folded == total


def test_anti_join_equals_window_cancel_flag(shop):
    ua = shop.user_actions
    flagged = facts.cancel_flag(ua).filter("is_canceled = 0").drop("is_canceled")
    anti = facts.without_cancelled(ua, facts.cancelled_orders(ua))
    assert rows(flagged) == rows(anti, *flagged.columns)


def test_input_order_does_not_matter(spark, shop):
    shuffled = td.Shop(shop.user_actions.orderBy(F.rand(7)), shop.orders.orderBy(F.rand(3)),
                       shop.products, shop.courier_actions,
                       shop.order_items.orderBy(F.rand(5)))
    for name in ("e6", "m6"):
        assert rows(METRICS[name](shuffled)) == rows(METRICS[name](shop))


def test_members_table_equals_assign_rule(spark, shop):
    users = spark.read.parquet(f"{SF_SMALL}/customer.parquet").select(
        F.col("c_custkey").alias("user_id"))
    rule = F.expr(td.CAMPAIGN_RULE_SQL)
    members = users.select(rule.alias("campaign_id"), "user_id").filter("campaign_id > 0")
    by_table = td.Campaigns(spend=td.SPEND, members=members)
    assert rows(M.m6_cumulative_arppu(shop, by_table)) == rows(METRICS["m6"](shop))
    assert rows(M.m1_cac(shop, by_table)) == rows(M.m1_cac(shop, td.campaigns()))
