"""Physical-plan assertions: no cartesian or nested-loop joins, no Python
evaluation, single-partition exchanges only above aggregates, filters and
column pruning reaching the Parquet scans."""

from __future__ import annotations

import re
from itertools import takewhile

import pytest

from conftest import SF_SMALL
from orderlytics.plans import oracle, registry

QUERIES = registry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(params=["as they come", "off"])
def broadcasts(spark, request):
    """Plans at this scale broadcast every small table; at scale they do not."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if request.param == "off":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", sorted(oracle.METRICS))
def test_metric_plan_shape(spark, name, broadcasts):
    p = plan(QUERIES[name](spark, SF_SMALL))
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython",
                "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert bad not in p, (name, bad)
    # A single-partition exchange may only carry rows that were aggregated.
    nodes = _tree(p)
    for i, (_, text) in enumerate(nodes):
        if text.startswith("Exchange SinglePartition"):
            assert _reduced_below(nodes, i), name


def test_window_filter_reaches_the_scan(spark):
    p = plan(QUERIES["filter_ts_range"](spark, SF_SMALL))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", p), p


def test_only_needed_columns_are_read(spark):
    p = plan(QUERIES["e1_daily_revenue"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", p)
    assert "struct<l_orderkey:bigint,l_partkey:bigint>" in schemas, schemas
    assert all("l_shipdate" not in s for s in schemas)


@pytest.mark.parametrize("name", ["e7_gross_profit", "m1_cac", "e2_arpu_arppu_aov"])
def test_cancelled_ids_are_not_a_null_aware_anti_join(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    anti = re.findall(r"(?:BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin)[^\n]*LeftAnti[^\n]*", p)
    assert anti, p
    # the last flag of a hash join line is "null-aware anti join"
    assert not any(re.search(r"LeftAnti, Build\w+, true", line) for line in anti), anti


def test_not_in_would_be_null_aware(spark):
    """The check above can see the flag: plain NOT IN does plan null-aware."""
    ua = QUERIES["scan_user_actions"](spark, SF_SMALL)
    ua.createOrReplaceTempView("ua_probe")
    df = spark.sql("SELECT * FROM ua_probe WHERE order_id NOT IN "
                   "(SELECT order_id FROM ua_probe WHERE action = 'cancel_order')")
    assert re.search(r"LeftAnti, Build\w+, true", plan(df))


AGG = ("HashAggregate", "ObjectHashAggregate", "SortAggregate")
PASS_THROUGH = ("Project", "Filter", "BroadcastHashJoin", "Sort", "Window", "Union",
                "Generate", "SortMergeJoin", "ShuffledHashJoin", "Exchange", "AQEShuffleRead")


def _tree(plan_text: str):
    nodes = []
    for line in plan_text.splitlines():
        i = next((k for k, ch in enumerate(line) if ch.isalpha()), None)
        if i is not None:
            nodes.append((i // 3, line[i:]))
    return nodes


def _reduced_below(nodes, at: int) -> bool:
    """Following the first child down from ``at``, an aggregate comes before a scan."""
    depth = nodes[at][0]
    for d, text in nodes[at + 1:]:
        if d <= depth:
            return False
        if text.startswith(AGG):
            return True
        if not text.startswith(PASS_THROUGH):
            return False
        depth = d
    return False


@pytest.mark.parametrize("name", sorted(oracle.METRICS))
def test_no_raw_rows_reach_a_single_key_task(spark, name, broadcasts):
    """Every exchange that feeds an aggregate or a window carries rows that were
    already aggregated (partial aggregation or a reduced series), so a key that
    holds a third of the data is combined map-side before its shuffle."""
    nodes = _tree(QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString())
    for i, (d, text) in enumerate(nodes):
        if not text.startswith("Exchange"):
            continue
        parent = next((t for pd, t in reversed(nodes[:i]) if pd < d), "")
        if parent.startswith("Sort"):
            j = next(k for k in range(i - 1, -1, -1) if nodes[k][1] == parent)
            parent = next((t for pd, t in reversed(nodes[:j]) if pd < nodes[j][0]), "")
        if parent.startswith(AGG + ("Window",)):
            assert _reduced_below(nodes, i), (name, text)


@pytest.mark.parametrize("name, exchanges", [("e3_running_arpu", 1), ("e5_new_user_share", 2)])
def test_users_are_read_in_one_pass(spark, name, exchanges):
    """The actions are grouped once: per user (E3), or per user and day and then,
    reduced, in the window per user (E5)."""
    nodes = _tree(plan(QUERIES[name](spark, SF_SMALL)).split("== Initial Plan ==")[-1])
    by_user = [t for _, t in nodes if t.startswith("Exchange hashpartitioning(user_id#")]
    assert len(by_user) == exchanges, by_user


def test_m6_reads_the_action_log_once(spark):
    """Both its series come from one aggregate: the two parts of the log (orders and
    their cancellations) are read with their users once each."""
    scans = re.findall(r"ReadSchema: (struct<[^>]*>)", plan(QUERIES["m6_cumulative_arppu"](spark, SF_SMALL)))
    assert len([s for s in scans if "o_custkey" in s]) == 2, scans
    assert len([s for s in scans if "l_orderkey" in s]) == 1, scans


@pytest.mark.parametrize("name", ["agg_sum", "e6_product_share"])
def test_lines_are_counted_before_the_price_lookup(spark, name, broadcasts):
    """Nothing is dealt by product that was not counted by product in its task."""
    nodes = _tree(plan(QUERIES[name](spark, SF_SMALL)))
    below = lambda i: [t for _, t in takewhile(lambda n: n[0] > nodes[i][0], nodes[i + 1:])]
    by_product = [i for i, (_, t) in enumerate(nodes) if re.match(r"Exchange hashpartitioning\((l_partkey|product_id)#", t)
                  and any("l_partkey" in b for b in below(i))]
    assert by_product
    for i in by_product:
        assert nodes[i + 1][1].startswith("HashAggregate"), nodes[i + 1]


def test_e5_sums_lines_by_order_before_the_join(spark, broadcasts):
    """Lines reach the join to the order rows summed by order: no task sorts the lines."""
    nodes = _tree(plan(QUERIES["e5_new_user_share"](spark, SF_SMALL)).split("== Initial Plan ==")[-1])
    below = lambda i: [t for _, t in takewhile(lambda n: n[0] > nodes[i][0], nodes[i + 1:])]
    by_order = [i for i, (_, t) in enumerate(nodes) if re.match(r"(Exchange hashpartitioning|Sort \[)\(?(l_orderkey|order_id)#", t)
                and any("l_partkey" in b for b in below(i))]
    assert by_order
    for i in by_order:
        assert any(b.startswith("HashAggregate(keys=[order_id#") for b in below(i)), nodes[i]


def test_arrays_are_unnested_above_the_joins(spark, broadcasts):
    """M2 over arrays sorts one row per array: no sort or shuffle by order has the lines."""
    nodes = _tree(plan(QUERIES["m2_roi_arrays"](spark, SF_SMALL)).split("== Initial Plan ==")[-1])
    below = lambda i: [t for _, t in takewhile(lambda n: n[0] > nodes[i][0], nodes[i + 1:])]
    assert any(t.startswith("Generate") for _, t in nodes)
    for i, (_, t) in enumerate(nodes):
        if re.match(r"(Exchange hashpartitioning|Sort \[)\(?order_id#", t):
            assert not any(b.startswith("Generate") for b in below(i)), t


def test_skew_join_split_is_on(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
