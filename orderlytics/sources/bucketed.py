"""Orders and their lines stored bucketed by order id: read back, their join (and every
aggregate by order id above it) needs no shuffle of either table.

``write_bucketed`` deals both tables by order id once, one sorted file per bucket, into
``root``; ``open_bucketed`` declares the files in the session's own catalog, where
Spark learns the layout from, and returns the shop. A later session only opens.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from orderlytics.sources.tables import Shop


def _write(df: DataFrame, path: str, table: str, buckets: int) -> None:
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    (df.repartition(buckets, "order_id").write.format("parquet").bucketBy(buckets, "order_id").sortBy("order_id")
     .option("path", path).saveAsTable(table))
    spark.sql(f"DROP TABLE {table}")     # an external table: its files stay


def write_bucketed(shop: Shop, root: str, buckets: int) -> None:
    """Store the order headers and the order lines of a normalised shop under ``root``
    in ``buckets`` buckets of about 128 MB to 1 GB of lines each. Rows without order id
    are kept: they share a bucket."""
    if shop.order_items is None:
        raise ValueError("the lines of a bucketed shop are a table: pass order_items")
    _write(shop.order_headers(), f"{root}/orders", "orderlytics_writing_orders", buckets)
    _write(shop.order_items, f"{root}/order_items", "orderlytics_writing_order_items", buckets)


def open_bucketed(spark: SparkSession, shop: Shop, root: str, buckets: int, name: str = "shop") -> Shop:
    """``shop`` with its headers and lines read from ``root``, written by
    ``write_bucketed`` with as many ``buckets``. ``name`` prefixes the declared tables."""
    tables = {"orders": "order_id BIGINT, creation_time TIMESTAMP_NTZ", "order_items": "order_id BIGINT, product_id BIGINT"}
    for table, columns in tables.items():
        spark.sql(f"DROP TABLE IF EXISTS {name}_{table}")
        spark.sql(f"CREATE TABLE {name}_{table} ({columns}) USING parquet CLUSTERED BY (order_id) "
                  f"SORTED BY (order_id) INTO {buckets} BUCKETS LOCATION '{root}/{table}'")
    return replace(shop, orders=spark.table(f"{name}_orders"), order_items=spark.table(f"{name}_order_items"))
