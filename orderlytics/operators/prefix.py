"""Ordered windows over tables of any size: running sums, the previous row, row numbers.

A window without PARTITION BY sorts the whole table in one task, and one with it sorts
a hot partition in one task. Here the rows are dealt into ranges of (partition, order),
stored once, and scanned range by range. The totals of every range (one row each) go to
the driver, which adds them up in order and hands each range what comes before it: the
sums, the count and the last row of the partition that runs across its border.

Order columns ascend, NULLs last. ``running_totals`` follows SQL's default frame, so
rows with equal keys share a value: their sums are taken first, map-side, and a key of
a third of all rows is one row of the scan. ``lag`` and ``row_number`` tell equal rows
apart by a hash of the whole row, as SQL does arbitrarily.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlytics.session import store


def _key(columns: Sequence[str]) -> Column:
    """A struct that sorts as the columns do with NULLs last."""
    return F.struct(*[c for name in columns for c in (F.col(name).isNull(), F.col(name))]) if columns else F.lit(0)


def _plus(a: Column, b: Column) -> Column:
    """a + b, NULL only if both are."""
    return F.coalesce(a + b, a, b)


def _carried(parts: list, sums: Sequence[str]) -> list[tuple]:
    """(range, *sums, count, last row, partition): what comes before each range in the
    partition it begins with; ``parts`` in order, one row per range that is not empty."""
    out, group, before = [], None, None
    for part in parts:
        same = group is not None and part["first"] == group
        out.append((part["_p"], *(before if same else [None] * len(sums) + [0, None]), part["first"]))
        tail = [part["tail"][name] for name in sums] + [part["tail"]["_n"], part["tail"]["_last"]]
        if same and part["first"] == part["last"]:
            added = [a if b is None else b if a is None else a + b for a, b in zip(before[:-1], tail[:-1])]
            tail = [*added, tail[-1]]
        group, before = part["last"], tail
    return out


def scan(df: DataFrame, order: Sequence[str], sums: Mapping[str, str] | None = None,
         lags: Mapping[str, str] | None = None, number: str | None = None,
         partition: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """``df`` with, in the order of its rows within ``partition``: ``sums`` (name ->
    column) up to and with the row, ``lags`` (name -> column) of the row before, and
    the ``number`` of the row from 1."""
    spark = df.sparkSession
    sums, lags = dict(sums or {}), dict(lags or {})
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*partition, *order]
    tie = F.xxhash64(*df.columns)
    ranges = [F.col(c).asc_nulls_last() for c in keys]
    dealt = df.withColumn("_tie", tie).repartitionByRange(parts, *ranges, "_tie")
    # stored: the ranges of a second run of this shuffle need not be the same
    rows = store(dealt.withColumns({"_p": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "ranges")

    place = F.struct(_key(order), "_tie", "_row")
    last = F.max_by(F.struct(*[F.col(c).alias(name) for name, c in lags.items()]) if lags else F.lit(0), place)
    tails = rows.groupBy("_p", *partition).agg(
        *[F.sum(c).alias(name) for name, c in sums.items()], F.count("*").alias("_n"), last.alias("_last"))
    group = _key(partition)
    tails = tails.groupBy("_p").agg(F.min(group).alias("first"), F.max(group).alias("last"), F.max_by(
        F.struct(*sums, "_n", "_last"), group).alias("tail"))
    types = tails.schema["tail"].dataType
    carried = _carried(tails.orderBy("_p").collect(), list(sums))   # a row per range
    schema = T.StructType([T.StructField("_p", T.IntegerType())] + [
        T.StructField(f"_b_{f.name}", f.dataType) for f in types.fields] + [
        T.StructField("_first", tails.schema["first"].dataType)])
    before = spark.createDataFrame(carried, schema)

    at = Window.partitionBy("_p", *partition).orderBy(*[F.col(c).asc_nulls_last() for c in order], "_tie", "_row")
    upto = at.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(F.broadcast(before), "_p")      # a row per range
    opens = group.eqNullSafe(F.col("_first"))
    out = [F.col(c) for c in df.columns]
    for name, c in sums.items():
        out.append(_plus(F.sum(c).over(upto), F.when(opens, F.col(f"_b_{name}"))).alias(name))
    for name, c in lags.items():
        # the first row of a range takes the last of the range before
        out.append(F.when(opens & (F.row_number().over(at) == 1), F.col(f"_b__last.{name}")).otherwise(
            F.lag(c, 1).over(at)).alias(name))
    if number:
        out.append((F.row_number().over(at) + F.when(opens, F.col("_b__n")).otherwise(0)).cast("bigint").alias(number))
    return rows.select(*out)


def running_totals(df: DataFrame, cols: Sequence[str], order: Sequence[str], partition: Sequence[str] = (),
                   prefix: str = "total_", parts: int | None = None) -> DataFrame:
    """``df`` with SUM(c) OVER (PARTITION BY partition ORDER BY order) as ``<prefix>c``
    for each column; rows with equal keys share the value."""
    keys = [*partition, *order]
    per_key = df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cols])
    totals = scan(per_key, order, {prefix + c: c for c in cols}, partition=partition, parts=parts)
    totals = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[prefix + c for c in cols])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(totals, same).drop(*[f"_k_{k}" for k in keys])


def lag(df: DataFrame, col: str, order: Sequence[str], name: str, partition: Sequence[str] = (),
        parts: int | None = None) -> DataFrame:
    """``df`` with LAG(col, 1) OVER (PARTITION BY partition ORDER BY order)."""
    return scan(df, order, lags={name: col}, partition=partition, parts=parts)


def in_arrays(df: DataFrame, key: str, value: str, name: str, most: int = 64, parts: int | None = None) -> DataFrame:
    """key, part, ``name``: the values of each key as arrays of at most ``most``, ascending
    with NULLs last and cut in that order; ``part`` counts a key's arrays from 0. However
    large a key is, no task gathers more than ``most`` of its values for one array."""
    numbered = row_number(df.select(key, value), [value], "_n", [key], parts)
    part = F.floor((F.col("_n") - 1) / F.lit(most)).cast("bigint")
    grouped = numbered.groupBy(key, part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("_n", value))).alias("_v"))
    return grouped.select(key, "part", F.transform("_v", lambda v: v[value]).alias(name))


def row_number(df: DataFrame, order: Sequence[str], name: str, partition: Sequence[str] = (),
               parts: int | None = None) -> DataFrame:
    """``df`` with ROW_NUMBER() OVER (PARTITION BY partition ORDER BY order)."""
    return scan(df, order, number=name, partition=partition, parts=parts)
