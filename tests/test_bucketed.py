"""Orders and lines stored bucketed by order id join without an exchange."""

from __future__ import annotations

import pytest

from conftest import SF_ORACLE, SF_SMALL, rows
from orderlytics.operators import facts
from orderlytics.plans import economics as E
from orderlytics.sources import testdata as td
from orderlytics.sources.bucketed import open_bucketed, write_bucketed


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def exchanged(df):
    """The exchanges of the final plan, as (partitioning, column names read below)."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line], plan


def test_lines_join_without_an_exchange(spark, tmp_path, no_broadcast):
    shop = td.shop(spark, SF_ORACLE)
    write_bucketed(shop, str(tmp_path), 8)
    stored = open_bucketed(spark, shop, str(tmp_path), 8, "lines_join")
    cancelled = facts.cancelled_of(stored)
    moved, plan = exchanged(facts.valid_items(stored, cancelled))
    assert "Bucketed: true" in plan
    assert len(moved) == 1, plan                      # the cancelled ids alone
    assert len(exchanged(facts.valid_items(shop, cancelled))[0]) == 3
    moved, plan = exchanged(facts.existing_order_items(stored))
    assert not moved, plan
    assert rows(facts.valid_items(stored, cancelled)) == rows(facts.valid_items(shop, cancelled))


def test_metrics_over_a_bucketed_shop(spark, tmp_path):
    shop = td.shop(spark, SF_SMALL)
    write_bucketed(shop, str(tmp_path), 4)
    stored = open_bucketed(spark, shop, str(tmp_path), 4, "metrics_over")
    for metric in (E.e1_daily_revenue, E.e2_arpu_arppu_aov, E.e5_new_user_share):
        assert rows(metric(stored)) == rows(metric(shop))
    again = open_bucketed(spark, shop, str(tmp_path), 4, "metrics_over")
    assert again.order_items.count() == shop.order_items.count()


def test_array_shops_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        write_bucketed(td.shop(spark, SF_SMALL, normalised=False), str(tmp_path), 2)
