"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlytics.llm import scratch


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of ``edges`` (a, b), by
    alternating large and small stars until nothing changes: a logarithmic number
    of rounds even for long chains. Each minimum is combined in the map tasks and
    stored before it is joined back, so that a node with very many neighbours is an
    ordinary skewed join, which Spark splits. Loops and repeated edges add nothing;
    an empty graph gives an empty table."""
    rows = 3 * edges.count()  # edges, both ways, and a minimum for every node: all tables below
    now = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .distinct(), rows)
    state = None
    while True:
        both = now.union(now.select("v", "u"))
        low = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), rows)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.table(large.union(low.where("u <> m")).where("u <> v").distinct(), rows)
        low = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), rows)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.table(small.union(low).distinct(), rows)
        new = tuple(now.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select("v", "v").distinct())
        state = new
