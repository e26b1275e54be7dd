"""VAT and operating costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlytics.functions import MONEY_SUM
from orderlytics.sources.params import CostModel, VatRule


def _reduced(rule: VatRule) -> Column:
    if isinstance(rule.reduced, DataFrame):
        return F.col("_reduced")
    if isinstance(rule.reduced, Column):
        return rule.reduced
    # A bounded parameter list: Catalyst turns it into a hash-set lookup.
    return F.col("name").isin(list(rule.reduced))


def inclusive_vat(price: Column, rate: int) -> Column:
    """VAT contained in a tax-inclusive price, rounded to cents:
    ROUND(price / (100 + rate) * rate, 2), multiplied first so no digit is lost."""
    return F.round(price * F.lit(rate) / F.lit(100 + rate), 2)


def line_vat(lines: DataFrame, rule: VatRule) -> DataFrame:
    """Add ``tax`` per line. Products of unknown name take the standard rate. A table of
    names is joined, broadcast only if its measured size allows."""
    price = F.col("price")
    reduced = _reduced(rule)
    if isinstance(rule.reduced, DataFrame):
        names = rule.reduced.select("name").distinct().withColumn("_reduced", F.lit(True))
        lines = lines.join(names, "name", "left").select(*lines.columns, "_reduced")
    tax = (F.when(reduced, inclusive_vat(price, rule.reduced_rate))
           .otherwise(inclusive_vat(price, rule.standard_rate)))
    return lines.withColumn("tax", tax).drop("_reduced")


def daily_costs(df: DataFrame, model: CostModel) -> Column:
    """Costs of a day from its counts (``orders_packed``, ``orders_delivered``,
    ``couriers_count``; NULL counts as 0) under the tariff of its calendar
    month, any year. Months without a tariff give NULL."""
    month = F.month("dt")
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in
         ("orders_packed", "orders_delivered", "couriers_count")}
    expr = None
    for m, (fixed, pack, deliver, bonus) in sorted(model.tariffs.items()):
        cost = (F.lit(fixed) + F.lit(pack) * n["orders_packed"]
                + F.lit(deliver) * n["orders_delivered"] + F.lit(bonus) * n["couriers_count"])
        expr = (F.when(month == m, cost) if expr is None else expr.when(month == m, cost))
    if expr is None:
        return F.lit(None).cast(MONEY_SUM)
    return expr.cast(MONEY_SUM)
