"""Joins on a key of which a few values, or NULL, hold much of the rows.

A hash join sends all rows of one key to one task. AQE splits such a task only where
the join reads its shuffles directly: not below a second join on the same key, and not
where one side is an aggregate. Here the rows are told apart before any shuffle:

* rows whose key is **NULL** match nothing and go round the join;
* rows of the few **hot** keys meet a copy of the other side's rows of those keys: a
  broadcast of one row per hot key where one is enough, else a join on (key, salt);
* all **others** take the ordinary join.

``hot_keys`` finds the hot keys with a bounded frequent-items sketch, merged from the
tasks. The sketch decides only the route, never the result, so a stale or empty answer
is still right. Without hot keys the plan is the ordinary one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most hot keys that are told apart, and items the sketch tracks.
MOST, TRACKED = 1000, 16_384
#: A key with fewer rows is never hot: one task takes them easily.
LEAST_ROWS = 100_000
#: Ways in which the rows of a hot key are dealt where their partners are many.
WAYS = 64


@dataclass(frozen=True)
class HotKeys:
    """The hot values of ``key``, and whether NULL is one."""

    key: str
    values: tuple = ()
    nulls: bool = False

    def __bool__(self) -> bool:
        return bool(self.values) or self.nulls


def hot_keys(df: DataFrame, key: str, least_rows: int | None = None) -> HotKeys:
    """Keys that hold more rows of ``df`` than a task's fair share of a shuffle (one
    in ``spark.sql.shuffle.partitions``, of which at most ``MOST`` are looked for),
    and ``least_rows``. One pass over one column, with nothing shuffled but sketches."""
    parts = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST)
    least = LEAST_ROWS if least_rows is None else least_rows
    found = df.agg(F.expr(f"approx_top_k({key}, {MOST}, {TRACKED})").alias("top"), F.count("*").alias("rows"),
                   F.count(key).alias("keyed")).first()
    bound = max(found["rows"] / max(parts, 1), least)
    values = tuple(sorted(t["item"] for t in found["top"] or ()
                         if t["item"] is not None and t["count"] > bound))
    return HotKeys(key, values, found["rows"] - found["keyed"] > bound)


class Route:
    """Some rows of the left side, and how they are joined."""

    def __init__(self, hot: HotKeys | None, kind: str):
        self.hot, self.kind = hot, kind

    def _is_hot(self) -> Column:
        return F.col(self.hot.key).isin(list(self.hot.values))

    def take(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` that go this way."""
        if self.kind == "all":
            return df
        key = F.col(self.hot.key)
        if self.kind == "null":
            return df.filter(key.isNull())
        if self.kind == "hot":
            return df.filter(self._is_hot())
        others = key.isNotNull() if self.hot.nulls else F.lit(True)
        if self.hot.values:
            others = others & F.coalesce(~self._is_hot(), F.lit(True))
        return df.filter(others)

    def join(self, left: DataFrame, right: DataFrame, key: str, how: str, once: bool = False) -> DataFrame:
        """``left`` (rows of this route) joined to ``right`` on ``key``: ``left``,
        ``inner`` or ``left_anti``. ``once``: one row of ``right`` per key is enough,
        as it has one, or as repeated matches do not change what is computed."""
        if self.kind == "all":
            return left.join(right, key, how)
        if self.kind == "null":
            return left.join(right.filter(F.lit(False)), key, how)   # Spark drops the join
        if self.kind == "cold":
            return left.join(self.take(right), key, how)
        partners = self.take(right)
        if once or how == "left_anti":   # at most MOST rows
            return left.join(F.broadcast(partners.dropDuplicates([key])), key, how)
        dealt = left.withColumn("_way", F.pmod(F.xxhash64(*left.columns), F.lit(WAYS)))
        copies = partners.withColumn("_way", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WAYS - 1).cast("long"))))
        return dealt.join(copies, [key, "_way"], how).drop("_way")


def routed(df: DataFrame, hot: HotKeys | None, build: Callable[[Route, DataFrame], DataFrame]) -> DataFrame:
    """``build`` applied to the rows of each route, put together again. All joins on
    the hot key belong into one ``build``, so that the rows are told apart once."""
    if not hot:
        return build(Route(hot, "all"), df)
    kinds = ["cold"] + ["hot"] * bool(hot.values) + ["null"] * hot.nulls
    routes = [Route(hot, kind) for kind in kinds]
    return reduce(DataFrame.unionByName, [build(route, route.take(df)) for route in routes])


def split_join(left: DataFrame, right: DataFrame, key: str, how: str, hot: HotKeys | None,
               once: bool = False) -> DataFrame:
    """One join with the hot keys of ``left`` told apart."""
    return routed(left, hot, lambda route, rows: route.join(rows, right, key, how, once))
