"""A prepared shop (cancelled ids and priced lines materialised once) gives
the same thirteen metrics as the raw shop."""

from __future__ import annotations

import tempfile

from conftest import SF_SMALL, rows
from orderlytics.plans import dashboard
from orderlytics.sources import testdata as td


def _refresh(spark, shop):
    return dashboard.refresh(shop, td.campaigns(), activity=td.activity_shop(spark, SF_SMALL),
                             first_week=td.FIRST_WEEK, weekday_window=td.WEEKDAY_WINDOW,
                             folding=td.folding(), vat=td.vat_rule(), costs=td.cost_model())


def test_prepared_shop_gives_the_same_metrics(spark):
    raw = td.shop(spark, SF_SMALL)
    prepared = dashboard.prepare(raw, tempfile.mkdtemp(prefix="prep-", dir="/tmp"))
    plan = prepared.priced_lines._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan          # lineage cut at the prepared files
    a, b = _refresh(spark, raw), _refresh(spark, prepared)
    for name in a:
        assert rows(a[name]) == rows(b[name]), name
