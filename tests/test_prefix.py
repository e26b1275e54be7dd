"""Windows computed range by range equal Spark's own window, and no exchange of theirs
goes to a single partition."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from orderlytics.operators import prefix
from orderlytics.session import clear_stored

SCHEMA = "shop string, day date, id long, amount decimal(12,2), n long"


def table(spark, n=400, days=25, seed=1):
    """Ties, NULLs in every column, a day of a third of all rows, a shop of half."""
    rng = np.random.default_rng(seed)

    def maybe(x):
        return None if rng.random() < 0.06 else x

    rows = []
    for i in range(n):
        day = 7 if rng.random() < 1 / 3 else int(rng.integers(0, days))
        shop = "a" if rng.random() < 0.5 else str(rng.choice(["b", "c", "d", "e"]))
        rows.append((maybe(shop), maybe(dt.date(2024, 1, 1) + dt.timedelta(days=day)), i,
                     maybe(Decimal(int(rng.integers(-500, 9000))) / 100), maybe(int(rng.integers(0, 5)))))
    return spark.createDataFrame(rows, SCHEMA)


def ordered(*cols):
    return [F.col(c).asc_nulls_last() for c in cols]


def same(a, b):
    a, b = a.select(*sorted(a.columns)), b.select(*sorted(b.columns))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


@pytest.mark.parametrize("partition", [[], ["shop"], ["shop", "n"]])
@pytest.mark.parametrize("parts", [1, 3, 40])
def test_running_totals(spark, partition, parts):
    df = table(spark)
    w = Window.partitionBy(*partition).orderBy(*ordered("day")).rangeBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("amount").over(w).alias("total_amount"), F.sum("id").over(w).alias("total_id"))
    same(prefix.running_totals(df, ["amount", "id"], ["day"], partition, parts=parts), want)


@pytest.mark.parametrize("partition", [[], ["shop"], ["day"]])
@pytest.mark.parametrize("parts", [1, 4, 60])
def test_lag_and_row_number(spark, partition, parts):
    df = table(spark)
    w = Window.partitionBy(*partition).orderBy(*ordered("day", "id"))
    want = df.select("*", F.lag("amount", 1).over(w).alias("before"))
    same(prefix.lag(df, "amount", ["day", "id"], "before", partition, parts), want)
    want = df.select("*", F.row_number().over(w).cast("bigint").alias("number"))
    same(prefix.row_number(df, ["day", "id"], "number", partition, parts), want)


def test_equal_rows_are_told_apart(spark):
    """Rows with equal keys get numbers of their own, and each is the one before another."""
    df = table(spark)
    numbers = sorted(r["number"] for r in prefix.row_number(df, ["day"], "number", parts=9).collect())
    assert numbers == list(range(1, 401))
    before = [r["before"] for r in prefix.lag(df, "id", ["day"], "before", parts=9).collect()]
    assert before.count(None) == 1 and len(set(before)) == 400


def test_arrays_are_bounded(spark):
    """A key of half the rows is many arrays, which together hold its values in order."""
    rows = {}
    df = table(spark)
    for r in prefix.in_arrays(df, "shop", "amount", "amounts", most=7, parts=5).collect():
        assert 1 <= len(r["amounts"]) <= 7
        rows.setdefault(r["shop"], []).append((r["part"], r["amounts"]))
    held = {}
    for r in df.collect():
        held.setdefault(r["shop"], []).append(r["amount"])
    for shop, parts in rows.items():
        assert [p for p, _ in sorted(parts)] == list(range(len(parts)))
        assert [a for _, some in sorted(parts) for a in some] == sorted(held[shop], key=lambda a: (a is None, a or 0))
    assert rows.keys() == held.keys()


def test_empty_and_one_row(spark):
    df = table(spark)
    assert prefix.running_totals(df.limit(0), ["amount"], ["day"]).collect() == []
    assert prefix.lag(df.limit(0), "id", ["day"], "before").collect() == []
    row = prefix.row_number(df.filter("id = 3"), ["day"], "number").first()
    assert row["number"] == 1


def test_a_million_rows_without_a_single_task(spark):
    """One million rows, with ties, NULLs and a key of a third of them."""
    day = F.when(F.rand(3) < 0.02, None).when(F.rand(4) < 1 / 3, 77).otherwise((F.rand(5) * 3000).cast("long"))
    df = spark.range(1_000_000).select("id", day.alias("day"), (F.rand(6) * 1000).cast("long").alias("amount"))
    path = spark.sparkContext.getCheckpointDir() + "/million"
    df.write.mode("overwrite").parquet(path)
    df = spark.read.parquet(path)
    got = prefix.running_totals(df, ["amount"], ["day"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    w = Window.orderBy(*ordered("day")).rangeBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("amount").over(w).alias("total_amount"))
    digest = F.sum(F.xxhash64("id", "day", "amount", "total_amount").cast("decimal(38,0)"))
    assert got.agg(digest, F.count("*")).first() == want.agg(digest, F.count("*")).first()
    for out in (prefix.lag(df, "id", ["day", "id"], "before"), prefix.row_number(df, ["day", "id"], "number")):
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    clear_stored(spark)
