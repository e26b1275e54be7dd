"""Refresh every metric of the dashboard from one preparation.

Ten of the thirteen metrics start from the same two intermediate results: the
cancelled order ids and the priced lines of valid orders (a scan of the orders
and their lines, an anti join and a product lookup, i.e. the bulk of the I/O
at scale). ``prepare`` writes both once as Parquet into the folder the cluster
names in ``spark.checkpoint.dir`` and returns a shop whose metrics read them
back: lineage is cut there, so a lost executor costs a re-read of the prepared
files instead of a recomputation from the raw tables, and later metrics get
column pruning and filter pushdown on the prepared lines.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame

from orderlytics.operators import facts
from orderlytics.plans import economics as E
from orderlytics.plans import marketing as M
from orderlytics.session import stored_folder
from orderlytics.sources.params import (FIRST_WEEK, WEEKDAY_WINDOW, Campaigns, CostModel,
                                        Folding, VatRule)
from orderlytics.sources.tables import Shop


def prepare(shop: Shop, folder: str | None = None) -> Shop:
    """Materialise the cancelled ids and the priced valid lines once, in ``folder`` or
    among the application's stored tables, which ``session.clear_stored`` deletes."""
    spark = shop.user_actions.sparkSession
    root = folder or f"{stored_folder(spark)}/prepared-{uuid.uuid4().hex}"
    cancelled = facts.cancelled_orders(shop.user_actions)
    cancelled.write.mode("overwrite").parquet(f"{root}/cancelled_ids")
    cancelled = spark.read.parquet(f"{root}/cancelled_ids")
    lines = facts.order_lines(replace(shop, cancelled_ids=None, priced_lines=None), cancelled)
    lines.write.mode("overwrite").parquet(f"{root}/priced_lines")
    lines = spark.read.parquet(f"{root}/priced_lines")
    return replace(shop, cancelled_ids=cancelled, priced_lines=lines)


def refresh(shop: Shop, campaigns: Campaigns, activity: Shop | None = None,
            first_week: tuple = FIRST_WEEK, weekday_window: tuple = WEEKDAY_WINDOW,
            folding: Folding = Folding(), vat: VatRule = VatRule(),
            costs: CostModel = CostModel()) -> dict[str, DataFrame]:
    """All thirteen metrics of a (prepared) shop. ``activity`` is the shop whose
    action log feeds retention (defaults to ``shop``)."""
    activity = activity or shop
    return {
        "m1_cac": M.m1_cac(shop, campaigns),
        "m2_roi": M.m2_roi(shop, campaigns),
        "m3_avg_check": M.m3_avg_check(shop, campaigns, first_week),
        "m4_retention": M.m4_retention(activity),
        "m5_campaign_retention": M.m5_campaign_retention(activity, campaigns),
        "m6_cumulative_arppu": M.m6_cumulative_arppu(shop, campaigns),
        "e1_daily_revenue": E.e1_daily_revenue(shop),
        "e2_arpu_arppu_aov": E.e2_arpu_arppu_aov(shop),
        "e3_running_arpu": E.e3_running_arpu(shop),
        "e4_weekday_arpu": E.e4_weekday_arpu(shop, weekday_window),
        "e5_new_user_share": E.e5_new_user_share(shop),
        "e6_product_share": E.e6_product_share(shop, folding),
        "e7_gross_profit": E.e7_gross_profit(shop, vat, costs),
    }
