"""Canonical tables of the order service and the `Shop` container.

The four tables (column names are the contract every operator relies on):

  user_actions     user_id BIGINT, order_id BIGINT, action STRING, time TIMESTAMP_NTZ
  orders           order_id BIGINT, creation_time TIMESTAMP_NTZ, product_ids ARRAY<BIGINT>
  products         product_id BIGINT, name STRING, price DECIMAL(12,2)
  courier_actions  courier_id BIGINT, order_id BIGINT, action STRING, time TIMESTAMP_NTZ

Orders carry their products as a nested array (bag semantics: a product may
repeat). A store that keeps order lines normalised can hand them over as
``order_items(order_id, product_id)`` instead; operators then join headers to
items rather than building and exploding arrays, which saves a shuffle of the
largest table. Both forms give the same rows: operators reach the items through
the order rows, so items of orders missing from ``orders`` are ignored and an
order listed twice gives its lines twice, exactly as with the nested form.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

USER_ACTIONS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("order_id", T.LongType()),
    T.StructField("action", T.StringType()),
    T.StructField("time", T.TimestampNTZType()),
])
ORDERS = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("creation_time", T.TimestampNTZType()),
    T.StructField("product_ids", T.ArrayType(T.LongType())),
])
PRODUCTS = T.StructType([
    T.StructField("product_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("price", T.DecimalType(12, 2)),
])
COURIER_ACTIONS = T.StructType([
    T.StructField("courier_id", T.LongType()),
    T.StructField("order_id", T.LongType()),
    T.StructField("action", T.StringType()),
    T.StructField("time", T.TimestampNTZType()),
])
ORDER_ITEMS = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("product_id", T.LongType()),
])

CANCEL = "cancel_order"
DELIVER = "deliver_order"


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast the contract columns (extra columns are dropped, so the
    Parquet scan reads only what the contract needs)."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df.select([_exact(df, f).alias(f.name) for f in schema.fields])


def _exact(df: DataFrame, field: T.StructField):
    """The column as the contract's type. A decimal that the type would round (a price
    below a cent) is an error."""
    c = F.col(field.name)
    to = c.cast(field.dataType)
    if not isinstance(field.dataType, T.DecimalType) or df.schema[field.name].dataType == field.dataType:
        return to
    return F.when(c.isNull() | (to == c), to).otherwise(F.raise_error(
        F.concat(F.lit(f"{field.name} with more decimals than {field.dataType.simpleString()}: "), c.cast("string"))))


@dataclass(frozen=True)
class Shop:
    """The tables one metric run reads. Only the ones a metric needs are touched;
    Spark plans are lazy, so unused tables cost nothing."""

    user_actions: DataFrame
    orders: DataFrame
    products: DataFrame
    courier_actions: DataFrame | None = None
    order_items: DataFrame | None = None
    # Set by ``plans.dashboard.prepare``: the cancelled order ids and the priced
    # lines of valid orders, materialised once and shared by every metric.
    cancelled_ids: DataFrame | None = None
    priced_lines: DataFrame | None = None
    # What was measured of these tables and only guides plans (hot order ids).
    measured: dict = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def from_tables(cls, user_actions, orders, products, courier_actions=None, order_items=None):
        return cls(
            conform(user_actions, USER_ACTIONS),
            conform(orders, ORDERS) if "product_ids" in orders.columns else orders.select(
                F.col("order_id").cast("bigint"), F.col("creation_time").cast("timestamp_ntz")),
            conform(products, PRODUCTS),
            None if courier_actions is None else conform(courier_actions, COURIER_ACTIONS),
            None if order_items is None else conform(order_items, ORDER_ITEMS),
        )

    @classmethod
    def read_parquet(cls, root: str, spark, normalised: bool = False) -> Shop:
        """Read the canonical tables from ``root/<table>`` Parquet folders
        (``order_items`` too when ``normalised``)."""
        def rd(name):
            return spark.read.parquet(f"{root}/{name}")
        return cls.from_tables(rd("user_actions"), rd("orders"), rd("products"),
                               rd("courier_actions"), rd("order_items") if normalised else None)

    def write_parquet(self, root: str, mode: str = "errorifexists") -> None:
        """Write the canonical tables to ``root/<table>`` Parquet folders (the
        layout ``read_parquet`` reads); normalised items go to ``order_items``."""
        tables = {"user_actions": self.user_actions, "orders": self.orders,
                  "products": self.products, "courier_actions": self.courier_actions,
                  "order_items": self.order_items}
        for name, df in tables.items():
            if df is not None:
                df.write.mode(mode).parquet(f"{root}/{name}")

    def order_headers(self) -> DataFrame:
        """order_id, creation_time (the array column pruned away)."""
        return self.orders.select("order_id", "creation_time")
