"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame, each over
the whole test tables through the role adapters of ``sources.testdata``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from orderlytics.plans import economics as E
from orderlytics.plans import marketing as M
from orderlytics.plans import oracle
from orderlytics.sources import testdata as td

Query = Callable[[SparkSession, str], DataFrame]


def as_double(df: DataFrame) -> DataFrame:
    """``df`` with its decimals as DOUBLE: how the registered metrics leave, beside
    an oracle that divides in DOUBLE. The library itself returns decimals."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
                       else F.col(f.name) for f in df.schema.fields])


def _doubled(query: Query) -> Query:
    return lambda s, d: as_double(query(s, d))


def _metrics() -> dict[str, Query]:
    return {name: _doubled(query) for name, query in {
        "m1_cac": lambda s, d: M.m1_cac(td.shop(s, d), td.campaigns()),
        "m2_roi": lambda s, d: M.m2_roi(td.shop(s, d), td.campaigns()),
        "m3_avg_check": lambda s, d: M.m3_avg_check(td.shop(s, d), td.campaigns(), td.FIRST_WEEK),
        "m4_retention": lambda s, d: M.m4_retention(td.activity_shop(s, d)),
        "m5_campaign_retention": lambda s, d: M.m5_campaign_retention(
            td.activity_shop(s, d), td.campaigns()),
        "m6_cumulative_arppu": lambda s, d: M.m6_cumulative_arppu(td.shop(s, d), td.campaigns()),
        "e1_daily_revenue": lambda s, d: E.e1_daily_revenue(td.shop(s, d)),
        "e2_arpu_arppu_aov": lambda s, d: E.e2_arpu_arppu_aov(td.shop(s, d)),
        "e3_running_arpu": lambda s, d: E.e3_running_arpu(td.shop(s, d)),
        "e4_weekday_arpu": lambda s, d: E.e4_weekday_arpu(td.shop(s, d), td.WEEKDAY_WINDOW),
        "e5_new_user_share": lambda s, d: E.e5_new_user_share(td.shop(s, d)),
        "e6_product_share": lambda s, d: E.e6_product_share(td.shop(s, d), td.folding()),
        "e7_gross_profit": lambda s, d: E.e7_gross_profit(
            td.shop(s, d), td.vat_rule(), td.cost_model()),
        # the same metrics over the other forms of their inputs
        "m1_cac_members": lambda s, d: M.m1_cac(td.shop(s, d), td.member_campaigns(s, d)),
        "m6_cumulative_arppu_members": lambda s, d: M.m6_cumulative_arppu(
            td.shop(s, d), td.member_campaigns(s, d)),
        "e7_gross_profit_names": lambda s, d: E.e7_gross_profit(
            td.shop(s, d), td.vat_names(s, d), td.cost_model()),
        "e1_daily_revenue_arrays": lambda s, d: E.e1_daily_revenue(td.fragment_shop(s, d)),
        "m2_roi_arrays": lambda s, d: M.m2_roi(td.fragment_shop(s, d), td.campaigns()),
    }.items()}


def queries() -> dict[str, Query]:
    from orderlytics.plans import atoms
    out = _metrics()
    out.update(atoms.queries())
    return out


def oracle_sql() -> dict[str, str]:
    from orderlytics.plans import atoms
    out = dict(oracle.METRICS)
    out.update(oracle.FORMS)
    out.update(atoms.oracle_sql())
    return out
