"""Hot order ids and missing ones: joins with the hot keys told apart equal plain joins,
and no task of the metrics gets much more than the median."""

from __future__ import annotations

import json
import os
import subprocess
import sys

import numpy as np
import pytest

from conftest import micro_shop, rows, ts
from orderlytics.operators import facts, skew
from orderlytics.operators.skew import HotKeys, hot_keys, routed, split_join


def sides(spark):
    rng = np.random.default_rng(3)
    left = [(i, None if rng.random() < 0.3 else 5 if rng.random() < 0.4 else int(rng.integers(0, 30))) for i in range(600)]
    right = [(k, v) for k in [*range(0, 25), None] for v in range(40 if k == 5 else int(rng.integers(0, 3)))]
    return (spark.createDataFrame(left, "i int, k long"), spark.createDataFrame(right, "k long, v int"))


HOT = [HotKeys("k"), HotKeys("k", (5,)), HotKeys("k", (), True), HotKeys("k", (5, 8, 99), True)]


@pytest.mark.parametrize("hot", HOT)
@pytest.mark.parametrize("how", ["left", "inner", "left_anti"])
def test_split_join_equals_the_join(spark, hot, how):
    left, right = sides(spark)
    assert rows(split_join(left, right, "k", how, hot), *left.columns) == rows(left.join(right, "k", how), *left.columns)
    got, want = split_join(left, right, "k", how, hot), left.join(right, "k", how)
    assert rows(got, *want.columns) == rows(want)


@pytest.mark.parametrize("hot", HOT)
def test_one_partner_is_enough(spark, hot):
    left, right = sides(spark)
    single = right.dropDuplicates(["k"])
    want = left.join(single.withColumnRenamed("v", "w"), "k", "left").drop("w")
    got = split_join(left, single, "k", "left", hot, once=True).drop("v")
    assert rows(got, "i", "k") == rows(want, "i", "k")


def test_hot_keys_are_found(spark):
    left, _ = sides(spark)
    assert hot_keys(left, "k") == HotKeys("k")                    # too few rows to matter
    assert hot_keys(left, "k", least_rows=50) == HotKeys("k", (5,), True)
    assert hot_keys(left.limit(0), "k", 0) == HotKeys("k")
    assert hot_keys(left.filter("k is null"), "k", 0) == HotKeys("k", (), True)


def test_without_hot_keys_the_plan_is_the_plain_one(spark):
    left, right = sides(spark)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(split_join(left, right, "k", "left", HotKeys("k"))).count("Join") == 1
    hot = routed(left, HotKeys("k", (5,), True), lambda route, part: route.join(
        route.join(part, right, "k", "left_anti"), right, "k", "left"))
    # two joins for the others, two for the hot key, none for NULL
    assert plan(hot).count("Join ") == 4


def test_metrics_with_routes_equal_those_without(spark, monkeypatch):
    c = "create_order"
    acts = [(u % 7, None if u % 5 == 0 else 1 if u % 3 else u, c if u % 11 else "cancel_order", ts(1 + u % 9)) for u in range(120)]
    orders = [(o, ts(1 + o % 9), [1, 2, o % 4]) for o in range(0, 120, 2)] + [(1, ts(3), [2, 2])]
    products = [(1, "a", 1.5), (2, "b", 2.25), (3, "c", 0)]

    def answers(least):
        monkeypatch.setattr(skew, "LEAST_ROWS", least)
        shop = micro_shop(spark, acts, orders, products)
        import skew_probe as p
        camp = p.Campaigns(spend={0: 10, 1: 20}, assign=p.F.col("user_id") % 2)
        assert bool(facts.hot_orders(shop)) == (least == 1)
        out = [rows(f) for f in (p.M.m2_roi(shop, camp), p.M.m3_avg_check(shop, camp), p.M.m6_cumulative_arppu(shop, camp),
                                 p.M.m1_cac(shop, camp), p.E.e2_arpu_arppu_aov(shop), p.E.e3_running_arpu(shop),
                                 p.E.e5_new_user_share(shop), facts.campaign_order_lines(shop, camp),
                                 facts.lines_of_actions(shop, facts.campaign_actions(shop, camp)))]
        assert all(out)
        return out

    assert answers(1) == answers(1 << 60)


@pytest.fixture(scope="module")
def probe(tmp_path_factory):
    """Ratios and answers of a kind of actions, each kind run once."""
    here, found = os.path.dirname(os.path.abspath(__file__)), {}

    def run(kind):
        if kind not in found:
            out = subprocess.run([sys.executable, f"{here}/skew_probe.py", str(tmp_path_factory.mktemp(kind)), kind],
                                 capture_output=True, text=True, timeout=600)
            assert out.returncode == 0, out.stderr[-3000:]
            found[kind] = json.loads(out.stdout.strip().splitlines()[-1])
        return found[kind]

    return run


@pytest.mark.parametrize("kind", ["hot", "null"])
def test_no_task_gets_much_more_than_the_median(probe, kind):
    ratios = probe(kind)["ratios"]
    assert set(ratios) == {"m2", "m3", "m6", "e2", "e5"}
    assert max(ratios.values()) < 3, ratios


def test_the_measure_sees_the_skew(probe):
    """Without routes some task gets most of the rows; the answers are the same."""
    plain = probe("plain-hot")
    assert max(plain["ratios"].values()) > 6, plain["ratios"]
    assert probe("hot")["rows"] == plain["rows"]
