"""Sums below a join equal sums above it, and money stays exact through the metrics."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from conftest import SF_ORACLE, micro_shop, rows, ts
from orderlytics.functions import money_total
from orderlytics.operators import facts
from orderlytics.plans import economics as E
from orderlytics.sources import testdata as td
from orderlytics.sources.tables import Shop

C = "create_order"


def awkward(spark) -> Shop:
    """A free product, an unknown one, NULL ids, a product listed twice, a hot one."""
    orders = [(o, ts(1 + o % 5), [1] * 9 + [2, o % 4, 77, None]) for o in range(40)] + [(None, ts(1), [1]), (3, ts(2), None)]
    products = [(1, "hot", "1.11"), (2, "free", 0), (3, "twice", "2.50"), (3, "again", "0.25"), (0, None, "3.33")]
    return micro_shop(spark, [(1, o, "cancel_order" if o % 9 == 0 else C, ts(1)) for o in range(40)], orders, products)


def test_product_revenue_equals_the_sum_over_lines(spark):
    for shop in (awkward(spark), td.shop(spark, SF_ORACLE)):
        lines = facts.order_lines(shop)
        want = lines.groupBy("product_id", "name").agg(money_total("price").alias("revenue"))
        assert rows(facts.product_revenue(shop)) == rows(want)


def test_order_prices_equal_the_sum_over_lines(spark):
    shop = awkward(spark)
    items = shop.orders.select("order_id", F.explode("product_ids").alias("product_id"))
    normal = Shop(shop.user_actions, shop.orders.select("order_id", "creation_time").distinct(), shop.products, None, items)
    for s in (shop, normal, td.shop(spark, SF_ORACLE)):
        lines = facts.with_products(facts.existing_order_items(s), s.products)
        want = lines.filter("order_id IS NOT NULL").groupBy("order_id").agg(money_total("price").alias("order_price"))
        assert rows(facts.order_prices(s).filter("order_id IS NOT NULL")) == rows(want)


def test_a_running_total_of_a_quadrillion_is_exact_to_the_cent(spark):
    n = 120_001
    orders = spark.range(n).select(F.col("id").alias("order_id"), F.expr("TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(cast(id % 3 AS int))")
                                   .alias("creation_time"))
    items = spark.range(n).select(F.col("id").alias("order_id"), (F.col("id") % 2).alias("product_id"))
    products = spark.createDataFrame([(0, "a", Decimal("9999999999.99")), (1, "b", Decimal("9999999999.98"))],
                                     "product_id long, name string, price decimal(12,2)")
    actions = spark.createDataFrame([], "user_id long, order_id long, action string, time timestamp_ntz")
    shop = Shop.from_tables(actions, orders, products, None, items)
    last = E.e1_daily_revenue(shop).orderBy(F.desc("dt")).first()
    total = 60_001 * Decimal("9999999999.99") + 60_000 * Decimal("9999999999.98")
    assert total > 10 ** 15 and last["total_revenue"] == total
    assert float(total) != total       # DOUBLE would not do
