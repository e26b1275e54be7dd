"""Nearest neighbours by inner product with a permutation index.

A vector is represented by its nearest pivots in order. Rows are dealt by hash into
blocks; each block posts its vectors, with the pivot's place in their order, in one
inverted file per pivot. A query sums the footrule distance between the orders over
the files of its own pivots; the part of the block with the smallest distances is
reranked by the true inner products. The best of all blocks are merged.

The queries are a stated part of the rows and meet every block; blocks of queries
and of rows bound what a task holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlytics.llm import scratch

#: Pivots are this many rows, those with the smallest hash of the id.
PIVOTS = 256
#: Nearest pivots in a vector's order; share of a block that is reranked, and least rows of it.
ORDER, SHARE, LEAST = 48, 0.45, 1000
#: Rows and queries in a block.
ROWS, QUERIES = 16_000, 1_000


def usable(vector: Column) -> Column:
    """Neither NULL nor zero, and of finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _orders(x: np.ndarray, pivots: np.ndarray, order: int) -> np.ndarray:
    near = x @ pivots.T
    order = min(order, len(pivots))
    top = np.argpartition(-near, order - 1, axis=1)[:, :order]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray,
                 k: int, order: int, share: float, least: int):
    """(query, id, score) of each query's best ``k`` rows of the block."""
    orders = _orders(x, pivots, order)
    m = orders.shape[1]
    by = np.argsort(orders.ravel(), kind="stable")
    ends = np.searchsorted(orders.ravel()[by], np.arange(len(pivots) + 1))
    vector, place = by // m, (by % m).astype(np.int32)
    kept = min(len(ids), max(least, int(np.ceil(share * len(ids)))))
    for q, query, own in zip(query_ids, queries, _orders(queries, pivots, order)):
        distance = np.zeros(len(ids), np.int32)  # less what it is without common pivots
        for i, pivot in enumerate(own):
            file = slice(ends[pivot], ends[pivot + 1])
            distance[vector[file]] += np.abs(place[file] - i) - (m - i) - (m - place[file])
        near = np.argpartition(distance, kept - 1)[:kept] if kept < len(ids) else np.arange(len(ids))
        near = near[ids[near] != q]
        score = x[near] @ query
        best = np.lexsort((ids[near], -score))[:k]
        yield q, ids[near[best]], score[best]


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            pivots: int = PIVOTS, order: int = ORDER, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row where ``is_query`` holds,
    its ``k`` nearest other rows found, by inner product in double precision, ties to
    the smaller id. Recall is that of the index; with at most ``least`` rows in a
    block it is exact.

    Vectors that are NULL, zero, or hold NULL or non-finite components, and rows
    without id, take no part, nor do vectors of another length than most. Of rows
    repeated with one id, one counts. An empty table gives an empty result."""
    spark = rows.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    clean = (rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"), is_query.alias("query"))
             .where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
             .groupBy("vec_id").agg(F.min(F.struct("vector", "query")).alias("row")).select("vec_id", "row.*"))
    clean = scratch.table(clean)
    schema = "query_id long, rank int, vec_id long, score double"
    sizes = clean.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    clean = clean.where(F.size("vector") == sizes["d"])
    n = sizes["count"]
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("vector").collect()
    shared = spark.sparkContext.broadcast(np.array([r["vector"] for r in sample]))  # PIVOTS vectors
    asked = clean.where("query")
    row_blocks, query_blocks = -(-n // ROWS), max(1, -(-asked.count() // QUERIES))
    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(row_blocks)).cast("int")
    ask = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(query_blocks)).cast("int")
    posted = clean.select("vec_id", "vector", F.lit(False).alias("query"), part.alias("part"),
                          F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("ask"))
    asking = asked.select("vec_id", "vector", F.lit(True).alias("query"),
                          F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("part"), ask.alias("ask"))

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("vec_id").to_numpy()
        x = table.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        is_q = table.column("query").to_numpy()
        out = [[], [], []]
        if not is_q.all():
            for q, near, score in search_block(ids[~is_q], x[~is_q], ids[is_q], x[is_q], shared.value, k, order, share, least):
                for column, values in zip(out, (np.full(len(near), q), near, score)):
                    column.append(values)
        kinds = (np.int64, np.int64, np.float64)
        return pa.table([pa.array(np.concatenate([np.zeros(0, t), *c]).astype(t)) for c, t in zip(out, kinds)],
                        names=["query_id", "vec_id", "score"])

    found = posted.unionByName(asking).groupBy("part", "ask").applyInArrow(search, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
