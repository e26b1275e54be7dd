"""Order is part of the result of the queries that sort: the sequence of their sort keys
equals that of the oracle, NULLs and ties included."""

from __future__ import annotations

import tempfile

import duckdb
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from conftest import SF_ORACLE, ts, micro_shop, rows
from orderlytics.plans import economics as E
from orderlytics.plans import registry, verify
from orderlytics.sources.params import Folding
from test_fuzz import make_tables

#: Sorted queries and their sort key.
SORTED = {"m1_cac": "cac", "m2_roi": "roi", "m3_avg_check": "avg_check", "e2_arpu_arppu_aov": "dt",
          "m2_roi_arrays": "roi", "e4_weekday_arpu": "weekday_number", "e6_product_share": "revenue", "sort_asc": "dt",
          "sort_desc": "revenue", "sort_alias_shadow": "price"}
#: Those with rows enough that no other order passes by chance.
LONG = ["e2_arpu_arppu_aov", "e4_weekday_arpu", "sort_asc", "sort_desc", "sort_alias_shadow"]

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


def in_order(spark, name, folder, con) -> bool:
    res = verify.compare(QUERIES[name](spark, folder), ORACLE[name], con, sort_key=SORTED[name])
    assert res["values_match"], res
    return res["order_match"]


@pytest.fixture(scope="module")
def awkward():
    """NULLs in all columns; names whose revenue is NULL."""
    folder = make_tables(47, tempfile.mkdtemp(prefix="fuzz-", dir="/tmp"), 0.03)
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return folder, con


@pytest.mark.parametrize("name", sorted(SORTED))
def test_sorted(spark, name, awkward):
    assert in_order(spark, name, SF_ORACLE, verify.duck(SF_ORACLE))
    assert in_order(spark, name, *awkward)


@pytest.mark.parametrize("name", LONG)
def test_a_missing_sort_is_seen(spark, name, awkward, monkeypatch):
    monkeypatch.setattr(DataFrame, "orderBy", lambda self, *cols, **kw: self.repartition(5))
    assert not in_order(spark, name, SF_ORACLE, verify.duck(SF_ORACLE))


def test_every_sorted_metric_is_covered():
    assert {n for n, sql in ORACLE.items() if sql.rstrip().splitlines()[-1].lstrip().startswith("ORDER BY")
            or "GROUP BY name ORDER BY" in sql or "d ORDER BY dt" in sql} == set(SORTED)


def test_null_revenue_comes_first_in_descending_order(spark):
    shop = micro_shop(spark, [(1, 1, "create_order", ts(1))], [(1, ts(1), [1, 2, 99])], [(1, "a", 10), (2, "b", 30)])
    got = [r["product_name"] for r in E.e6_product_share(shop, Folding(threshold=-1)).collect()]
    assert got[1:] == ["b", "a"] and len(rows(E.e6_product_share(shop, Folding(threshold=-1)))) == 3
