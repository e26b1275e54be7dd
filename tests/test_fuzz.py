"""Every registered query against its oracle on generated raw tables with
skewed and awkward data: one customer with a third of all orders, one day
with a third of all orders, a hot product, products missing from the catalogue,
lines of orders that do not exist, orders without lines, free products,
repeated product names, one very active event user; and a variant with NULLs
in every nullable raw column (keys included) and duplicated order and product keys."""

from __future__ import annotations

import datetime as dt
import tempfile

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from orderlytics.plans import registry, verify

START = dt.datetime(1998, 7, 1)
HOT_DAY = dt.datetime(1998, 9, 3)
NAMES = ["red apple", "red pepper", "bread", "milk", "tea", "rice", "salt", "jam"]


def _times(rng, n, hot_share):
    days = rng.integers(0, 123, n)
    hot = rng.random(n) < hot_share
    base = np.array([START + dt.timedelta(days=int(d)) for d in days])
    base[hot] = HOT_DAY
    minutes = rng.integers(0, 24 * 60, n)
    return [b + dt.timedelta(minutes=int(m)) for b, m in zip(base, minutes)]


def _nulls(rng, values, share, type_):
    """An arrow array with about ``share`` of the entries set to NULL."""
    mask = rng.random(len(values)) < share if share else None
    return pa.array(list(values), type_, mask=mask)


def make_tables(seed: int, folder: str, null_share: float = 0.0) -> str:
    rng = np.random.default_rng(seed)
    ns = null_share
    n_orders, n_parts, n_users = 900, 60, 120
    keys = rng.choice(np.arange(1, 20 * n_orders), n_orders, replace=False)
    if ns:
        keys[:5] = keys[5:10]                                     # duplicated order keys
    cust = rng.integers(0, n_users, n_orders)
    cust[rng.random(n_orders) < 1 / 3] = 7                       # a third of orders: user 7
    orders = pa.table({
        "o_orderkey": _nulls(rng, keys, ns / 2, pa.int64()),
        "o_custkey": _nulls(rng, cust, ns, pa.int64()),
        "o_orderdate": _nulls(rng, _times(rng, n_orders, 1 / 3), ns / 2, pa.timestamp("us")),
    })
    with_lines = keys[rng.random(n_orders) > 0.05]                # some orders have no lines
    if ns:
        with_lines = with_lines[~np.isin(with_lines, keys[5:7])]  # duplicated, without lines
    n_lines = 4000
    l_order = rng.choice(with_lines, n_lines)
    l_order[:20] = rng.integers(10**7, 10**7 + 50, 20)           # lines of unknown orders
    l_part = rng.integers(1, n_parts + 8, n_lines)                # ids above n_parts: unknown
    l_part[rng.random(n_lines) < 1 / 3] = 3                      # a third of lines: product 3
    lineitem = pa.table({
        "l_orderkey": _nulls(rng, l_order, ns / 2, pa.int64()),
        "l_partkey": _nulls(rng, l_part, ns, pa.int64()),
        "l_suppkey": _nulls(rng, rng.integers(0, 12, n_lines), ns, pa.int64()),
        "l_returnflag": _nulls(rng, rng.choice(["A", "N", "R"], n_lines), ns, pa.string()),
        "l_shipdate": _nulls(rng, _times(rng, n_lines, 0.2), ns / 2, pa.timestamp("us")),
    })
    cents = rng.integers(0, 50000, n_parts)
    cents[:3] = 0                                                 # free products
    part_keys = np.arange(1, n_parts + 1)
    if ns:
        part_keys[-3:] = [3, 4, 5]                                # duplicated product ids
    part = pa.table({
        "p_partkey": _nulls(rng, part_keys, ns, pa.int64()),
        "p_name": _nulls(rng, rng.choice(NAMES, n_parts), ns * 2, pa.string()),
        "p_retailprice": _nulls(rng, cents / 100.0, ns * 2, pa.float64()),
    })
    n_events = 3000
    users = rng.integers(0, n_users, n_events)
    users[rng.random(n_events) < 1 / 3] = 11                     # a third of events: user 11
    ev_times = [START + dt.timedelta(days=int(d), minutes=int(m)) for d, m in
                zip(rng.integers(0, 20, n_events), rng.integers(0, 1440, n_events))]
    events = pa.table({
        "event_id": pa.array(np.arange(n_events), pa.int64()),
        "ts": _nulls(rng, ev_times, ns / 2, pa.timestamp("us")),
        "user_id": _nulls(rng, users, ns, pa.int64()),
        "event_type": pa.array(rng.choice(["view", "click", "purchase"], n_events)),
    })
    for name, table in {"orders": orders, "lineitem": lineitem, "part": part,
                        "events": events}.items():
        pq.write_table(table, f"{folder}/{name}.parquet")
    return folder


QUERIES = registry.queries()
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module", params=[(11, 0.0), (29, 0.0), (47, 0.03)],
                ids=["skewed-a", "skewed-b", "with-nulls"])
def fuzz_dir(request):
    seed, null_share = request.param
    folder = make_tables(seed, tempfile.mkdtemp(prefix="fuzz-", dir="/tmp"), null_share)
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return folder, con


def test_every_query_matches_oracle_on_skewed_data(spark, fuzz_dir):
    folder, con = fuzz_dir
    failed = {}
    for name in sorted(QUERIES):
        res = verify.compare(QUERIES[name](spark, folder), ORACLE[name], con)
        if not res["ok"]:
            failed[name] = res
    assert not failed, failed


def test_nested_orders_match_normalised_items_on_awkward_data(spark):
    """The nested form (arrays per order, NULL ids kept) gives the same metrics
    as the normalised form on data with NULLs and duplicated keys."""
    from conftest import rows
    from orderlytics.plans import dashboard
    from orderlytics.sources import testdata as td
    folder = make_tables(47, tempfile.mkdtemp(prefix="fuzz-", dir="/tmp"), 0.03)
    nested, flat = td.shop(spark, folder, normalised=False), td.shop(spark, folder)
    kw = dict(activity=td.activity_shop(spark, folder), first_week=td.FIRST_WEEK,
              weekday_window=td.WEEKDAY_WINDOW, folding=td.folding(), vat=td.vat_rule(),
              costs=td.cost_model())
    a = dashboard.refresh(nested, td.campaigns(), **kw)
    b = dashboard.refresh(flat, td.campaigns(), **kw)
    for name in a:
        assert rows(a[name]) == rows(b[name]), name


def test_prepared_dashboard_matches_raw_on_awkward_data(spark):
    from conftest import rows
    from orderlytics.plans import dashboard
    from orderlytics.sources import testdata as td
    folder = make_tables(47, tempfile.mkdtemp(prefix="fuzz-", dir="/tmp"), 0.03)
    raw = td.shop(spark, folder)
    prepared = dashboard.prepare(raw, tempfile.mkdtemp(prefix="prep-", dir="/tmp"))
    kw = dict(activity=td.activity_shop(spark, folder), first_week=td.FIRST_WEEK,
              weekday_window=td.WEEKDAY_WINDOW, folding=td.folding(), vat=td.vat_rule(),
              costs=td.cost_model())
    a = dashboard.refresh(raw, td.campaigns(), **kw)
    b = dashboard.refresh(prepared, td.campaigns(), **kw)
    for name in a:
        assert rows(a[name]) == rows(b[name]), name
