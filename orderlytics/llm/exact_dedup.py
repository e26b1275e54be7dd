"""Exact de-duplication by content sort, in DataFrame operations only.

Texts are equal when identical after every run of space and 0x09-0x0D became one
space. Splitters sampled from the normalised texts deal them out by range, each
partition sorts its texts (spilling to disk as needed), which puts equal texts
next to each other, and a window over the sorted run compares neighbours in full.

A text with very many copies would fill one range. The 4n texts with most rows
(n: partitions) therefore get a salt as second sort key, so that the splitters cut
through their copies; every other text has at most 1/(4n) of the rows. Their
n part-groups each are then reduced to one, a table of at most 4n rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlytics.llm import scratch

#: Groups below this many rows are never salted.
LEAST_HOT = 256
#: Characters of a splitter. Splitters pass through the driver and must not grow
#: with the texts; beyond these, texts are dealt out by digest and sorted in full.
HEAD = 48


def normalised(text: str | Column) -> Column:
    """The text with every run of white space made one space; NULL is empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                n: int | None = None, least_hot: int = LEAST_HOT, carry: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (smallest id of the equal texts),
    group_size, kept, text_sha256 (of the normalised text). Other columns of
    ``docs`` are not read, unless ``carry`` adds row, a struct of all its columns.

    NULL texts equal empty ones. NULL ids come last: one stays only if no row of
    the group has an id. Of rows repeated with the same id and text, one stays.
    An empty table gives an empty result."""
    n = n or scratch.partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"),
                       *([F.struct(*docs.columns).alias("row")] if carry else []))
    more = ["row"] if carry else []
    rows = rows.withColumn("sha", F.sha2("norm", 256))
    hot = (rows.select("sha").groupBy("sha").count().orderBy(F.desc("count"), "sha").limit(4 * n)
           .where(F.col("count") >= least_hot).select("sha", F.lit(True).alias("hot")))
    salted = (rows.join(F.broadcast(hot), "sha", "left")  # at most 4n rows
              .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(n)))
                          .otherwise(F.lit(-1).cast("bigint"))).drop("hot"))
    salted = salted.withColumn("head", F.substring("norm", 1, HEAD))
    order = (Window.partitionBy("head", "sha", "salt", "norm")
             .orderBy(F.col("doc_id").asc_nulls_last()))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = scratch.table(
        salted.repartitionByRange(n, "head", "sha", "salt")
        .select("doc_id", "sha", (F.col("salt") >= 0).alias("salted"),
                F.first("doc_id").over(order).alias("first_id"),
                F.row_number().over(order).alias("place"),
                F.count(F.lit(1)).over(whole).alias("size"), *more))
    parts = (found.where("salted AND place = 1").groupBy("sha")
             .agg(F.min("first_id").alias("hot_id"), F.sum("size").alias("hot_size")))
    joined = found.join(F.broadcast(parts), "sha", "left")  # at most 4n rows
    keep = F.when(F.col("salted"), F.col("hot_id")).otherwise(F.col("first_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"),
        F.when(F.col("salted"), F.col("hot_size")).otherwise(F.col("size")).alias("group_size"),
        ((F.col("place") == 1) & F.col("first_id").eqNullSafe(keep)).alias("kept"),
        F.col("sha").alias("text_sha256"), *more)
