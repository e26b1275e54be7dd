"""A date window prunes the order lines right after their scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_ORACLE, SF_SMALL, rows
from orderlytics.operators import facts
from orderlytics.operators.pruning import id_bitmap, prune
from orderlytics.plans import economics as E
from orderlytics.plans import marketing as M
from orderlytics.sources import testdata as td


def test_no_row_is_lost(spark):
    ids = spark.createDataFrame([(i * 7919 - 300,) for i in range(500)] + [(None,)], "id long")
    big = spark.range(-5000, 60_000).select(F.col("id"), F.lit(1).alias("x")).unionByName(
        spark.createDataFrame([(None, 2)], "id long, x int"))
    want = sorted(r[0] for r in ids.join(big, "id").select("id").collect())
    for bits in (64, 1 << 10, 1 << 25):
        kept = prune(big, "id", id_bitmap(ids, "id", bits), bits)
        assert kept.columns == ["id", "x"]
        assert sorted(r[0] for r in ids.join(kept, "id").select("id").collect()) == want
    assert prune(big, "id", id_bitmap(ids, "id")).count() < 30      # hardly any collision
    assert prune(big, "id", id_bitmap(ids.limit(0), "id")).collect() == []


def test_bitmap_is_bounded(spark):
    assert id_bitmap(spark.range(200_000), "id", 1 << 12).count() == 64


def _lines_left(spark, window):
    """Order lines that are left after pruning by the orders of a window's actions."""
    shop = td.shop(spark, SF_ORACLE)
    acts = shop.user_actions.filter(facts.within("time", window))
    return prune(shop.order_items, "order_id", id_bitmap(acts, "order_id")).count()


def test_lines_fall_with_the_window(spark):
    start = td.FIRST_WEEK[0]
    all_lines = td.shop(spark, SF_ORACLE).order_items.count()
    month, week, none = (_lines_left(spark, (start, start + dt.timedelta(days=n))) for n in (30, 7, 0))
    assert none == 0 < week < month < all_lines / 20


def _below_exchange(plan: str, table: str) -> bool:
    """Every scan of ``table`` meets the bitmap before an exchange."""
    lines = plan.splitlines()
    scans = [i for i, line in enumerate(lines) if table in line and "Scan parquet" in line]
    assert scans
    for i in scans:
        depth = len(lines[i]) - len(lines[i].lstrip(" :+-*|"))
        seen = False
        for line in reversed(lines[:i]):
            d = len(line) - len(line.lstrip(" :+-*|"))
            if d < depth:
                depth = d
                if "_word#" in line and "Join" in line:
                    seen = True
                elif "Exchange" in line and "Broadcast" not in line:
                    break
        if not seen:
            return False
    return True


def test_m3_and_e4_prune_below_the_shuffle(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shop = td.shop(spark, SF_SMALL)
        for df in (M.m3_avg_check(shop, td.campaigns(), td.FIRST_WEEK), E.e4_weekday_arpu(shop, td.WEEKDAY_WINDOW)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert _below_exchange(plan, "l_orderkey"), plan
        plan = M.m2_roi(shop, td.campaigns())._jdf.queryExecution().executedPlan().toString()
        assert not _below_exchange(plan, "l_orderkey")      # the test can tell
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_pruned_metrics_equal_unpruned(spark, monkeypatch):
    shop = td.shop(spark, SF_ORACLE)
    pruned = rows(M.m3_avg_check(shop, td.campaigns(), td.FIRST_WEEK)), rows(E.e4_weekday_arpu(shop, td.WEEKDAY_WINDOW))
    monkeypatch.setattr(facts, "prune", lambda df, key, bitmap: df)
    plain = rows(M.m3_avg_check(shop, td.campaigns(), td.FIRST_WEEK)), rows(E.e4_weekday_arpu(shop, td.WEEKDAY_WINDOW))
    assert pruned == plain and len(pruned[1]) == 7
