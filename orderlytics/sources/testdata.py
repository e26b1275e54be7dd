"""Role adapters: the canonical order-service tables over the driver's
TPC-H-like test tables (``/root/testdata/sf*/<table>.parquet``).

  orders           orders -> order_id, creation_time (headers); the lines come as
  order_items      lineitem -> order_id, product_id (bag: duplicates kept).
                   The nested form (one product_ids array per order) is only built
                   for tests of the nested contract (``orders``) or in bounded
                   fragments (``order_fragments``).
  products         part -> product_id, name, price DECIMAL(12,2)
  user_actions     one create_order row per order at o_orderdate; orders with
                   o_orderkey % 20 = 7 also get a cancel_order row an hour later
  courier_actions  distinct (l_suppkey % 4, l_orderkey, l_shipdate) as accept_order;
                   lines with l_returnflag <> 'R' also give a distinct deliver_order
                   row at l_shipdate + 1 hour
  activity         events -> user_id, order_id NULL, event_type as action, ts as time
                   (the action log used by the retention metrics)

The oracle SQL (``plans.oracle``) builds the same roles independently in DuckDB.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlytics.sources.params import Campaigns, CostModel, Folding, VatRule
from orderlytics.sources.tables import Shop

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Parameters that fit the synthetic data (its dates and ids differ from the reference's).
CAMPAIGN_RULE_SQL = ("CASE WHEN user_id % 10 IN (1, 2, 3) THEN 1 "
                     "WHEN user_id % 10 IN (4, 5) THEN 2 ELSE 0 END")
SPEND = {1: Decimal("250000.0"), 2: Decimal("250000.0")}
FIRST_WEEK = (dt.date(1998, 9, 1), dt.date(1998, 9, 8))
WEEKDAY_WINDOW = (dt.date(1998, 8, 24), dt.date(1998, 9, 7))
OTHER_THRESHOLD = Decimal("1.5")
REDUCED_PREFIX = "red "
CANCEL_MOD, CANCEL_REM = 20, 7
COURIERS = 4


# Declared read schemas (only the columns the roles use): no schema-inference
# job per read, and the scan's ReadSchema is fixed up front.
SCHEMAS = {
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP_NTZ",
    "lineitem": ("l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_returnflag STRING, "
                 "l_shipdate TIMESTAMP_NTZ"),
    "part": "p_partkey BIGINT, p_name STRING, p_retailprice DOUBLE",
    "events": "ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def order_items(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"))


def order_headers(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("creation_time"))


def orders(spark, sf_dir) -> DataFrame:
    """The nested orders role with one array per order (test fixture for the
    nested contract). The array of an order is as large as the order, so no
    registered query builds it; they read ``order_items`` instead."""
    items = order_items(spark, sf_dir).groupBy("order_id").agg(_id_list().alias("product_ids"))
    return order_headers(spark, sf_dir).join(items, "order_id", "left")


def _id_list():
    """collect_list of product ids that keeps NULL ids (collect_list skips NULL
    values, so each id travels inside a struct and is taken out again)."""
    return F.transform(F.collect_list(F.struct("product_id")), lambda x: x["product_id"])


def order_fragments(spark, sf_dir, max_items: int = 64) -> DataFrame:
    """Nested order lines in fragments of at most ``max_items`` products:
    order_id, creation_time, product_ids. Lines are grouped by order and by a
    block of consecutive row ids, so no group exceeds ``max_items`` rows however
    large one order is. Row ids follow the file splits, so a recomputed task
    builds the same fragments; exploding them gives back every line once."""
    li = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
        (F.monotonically_increasing_id() / F.lit(max_items)).cast("bigint").alias("block"))
    frags = li.groupBy("order_id", "block").agg(_id_list().alias("product_ids"))
    return order_headers(spark, sf_dir).join(frags, "order_id").drop("block")


def products(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("price"))


def user_actions(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    create = o.select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("order_id"),
        F.lit("create_order").alias("action"), F.col("o_orderdate").alias("time"))
    cancel = o.filter(F.col("o_orderkey") % CANCEL_MOD == CANCEL_REM).select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("order_id"),
        F.lit("cancel_order").alias("action"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("time"))
    return create.unionByName(cancel)


def courier_actions(spark, sf_dir) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    courier = (F.col("l_suppkey") % COURIERS).alias("courier_id")
    accept = li.select(
        courier, F.col("l_orderkey").alias("order_id"),
        F.lit("accept_order").alias("action"), F.col("l_shipdate").alias("time")).distinct()
    deliver = li.filter(F.col("l_returnflag") != "R").select(
        courier, F.col("l_orderkey").alias("order_id"), F.lit("deliver_order").alias("action"),
        (F.col("l_shipdate") + F.expr("INTERVAL 1 HOUR")).alias("time")).distinct()
    return accept.unionByName(deliver)


def activity(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("user_id"), F.lit(None).cast("bigint").alias("order_id"),
        F.col("event_type").alias("action"), F.col("ts").alias("time"))


_SHOPS: dict = {}


def _shops(spark: SparkSession) -> dict:
    """The shops of a live session; those of stopped sessions are forgotten."""
    for old in [s for s in _SHOPS if s.sparkContext._jsc is None]:
        del _SHOPS[old]
    return _SHOPS.setdefault(spark, {})


def shop(spark: SparkSession, sf_dir: str, normalised: bool = True) -> Shop:
    """The canonical shop over the test tables. ``normalised`` hands the order
    lines over as items (no array round trip); False exercises the nested path.

    A shop is a set of lazy, immutable DataFrames, so one is built per session
    and folder and shared by every metric (as a user builds it once and asks
    many questions): the file listing and plan analysis of the base tables is
    not repeated for each query."""
    shops, key = _shops(spark), (sf_dir, normalised)
    if key not in shops:
        shops[key] = Shop.from_tables(
            user_actions(spark, sf_dir),
            order_headers(spark, sf_dir) if normalised else orders(spark, sf_dir),
            products(spark, sf_dir),
            courier_actions(spark, sf_dir),
            order_items(spark, sf_dir) if normalised else None,
        )
    return shops[key]


def activity_shop(spark: SparkSession, sf_dir: str) -> Shop:
    """The shop whose action log is ``events`` (for the retention metrics)."""
    shops, key = _shops(spark), (sf_dir, "activity")
    if key not in shops:
        base = shop(spark, sf_dir)
        shops[key] = Shop(activity(spark, sf_dir), base.orders, base.products,
                          base.courier_actions, base.order_items)
    return shops[key]


def fragment_shop(spark: SparkSession, sf_dir: str) -> Shop:
    """The shop whose orders carry their products as arrays, in fragments of at most 64
    (``order_fragments``): an order of many lines is several rows."""
    shops, key = _shops(spark), (sf_dir, "fragments")
    if key not in shops:
        base = shop(spark, sf_dir)
        shops[key] = Shop.from_tables(base.user_actions, order_fragments(spark, sf_dir), base.products,
                                      base.courier_actions)
    return shops[key]


def campaigns() -> Campaigns:
    return Campaigns(spend=SPEND, assign=F.expr(CAMPAIGN_RULE_SQL))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """campaign_id, user_id: the users of each campaign as a table. Those with remainder
    2 are listed in both; the lower campaign counts."""
    users = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id")).distinct()
    of = F.when(F.col("user_id") % 10 == 2, F.array(F.lit(1), F.lit(2))).when(
        (F.col("user_id") % 10).isin(1, 3), F.array(F.lit(1))).when(
        (F.col("user_id") % 10).isin(4, 5), F.array(F.lit(2)))
    return users.select(F.explode(of).alias("campaign_id"), "user_id")


def member_campaigns(spark: SparkSession, sf_dir: str) -> Campaigns:
    return Campaigns(spend=SPEND, members=members(spark, sf_dir))


def vat_names(spark: SparkSession, sf_dir: str) -> VatRule:
    """The VAT rule with its product names as a table."""
    names = read(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    return VatRule(reduced=names.filter(F.col("name").startswith(REDUCED_PREFIX)))


def vat_rule() -> VatRule:
    return VatRule(reduced=F.col("name").startswith(REDUCED_PREFIX))


def cost_model() -> CostModel:
    return CostModel()


def folding() -> Folding:
    return Folding(threshold=OTHER_THRESHOLD)
