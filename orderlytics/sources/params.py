"""Parameters of the metrics. Defaults are the reference's constants; the test
data passes its own (see ``sources.testdata``)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame

# ---------------------------------------------------------------------------
# These must equal the reference's constants for equal results.
CAMPAIGN_LABEL = "Кампания № "
CAMPAIGN_SPEND = Decimal("250000.0")
OTHER_LABEL = "ДРУГОЕ"
OTHER_THRESHOLD = Decimal("0.5")
REDUCED_VAT_NAMES = (
    "сахар", "сухарики", "сушки", "семечки", "масло льняное", "виноград",
    "масло оливковое", "арбуз", "батон", "йогурт", "сливки", "гречка",
    "овсянка", "макароны", "баранина", "апельсины", "бублики", "хлеб",
    "горох", "сметана", "рыба копченая", "мука", "шпроты", "сосиски",
    "свинина", "рис", "масло кунжутное", "сгущенка", "ананас", "говядина",
    "соль", "рыба вяленая", "масло подсолнечное", "яблоки", "груши",
    "лепешка", "молоко", "курица", "лаваш", "вафли", "мандарины",
)
REDUCED_VAT_RATE = 10
STANDARD_VAT_RATE = 20
# month: (fixed per day, per packed order, per delivered order, per bonus courier)
TARIFFS = {
    8: (Decimal("120000.0"), 140, 150, 400),
    9: (Decimal("150000.0"), 115, 150, 500),
}
BONUS_MIN_ORDERS = 5
RETENTION_DAYS = (0, 1, 7)
FIRST_WEEK = (dt.date(2022, 9, 1), dt.date(2022, 9, 8))
WEEKDAY_WINDOW = (dt.date(2022, 8, 26), dt.date(2022, 9, 9))
# The reference's two campaign member lists (171 and 236 user ids) are data,
# not code: pass them as a `members` DataFrame (campaign_id, user_id).
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Campaigns:
    """Which users each advertising campaign brought, and what it cost.

    Give either ``members`` (DataFrame campaign_id, user_id; when a user is
    listed in several campaigns the lowest id wins, like a CASE over the lists
    in id order) or ``assign`` (a Column over ``user_id`` yielding the campaign
    id, 0 or NULL for none). Only campaigns present in ``spend`` are reported.
    """

    spend: Mapping[int, Decimal]
    members: DataFrame | None = None
    assign: Column | None = None
    label_prefix: str = CAMPAIGN_LABEL

    def __post_init__(self):
        if (self.members is None) == (self.assign is None):
            raise ValueError("give exactly one of members or assign")


@dataclass(frozen=True)
class VatRule:
    """Tax-inclusive VAT: products named in ``reduced`` (a list of names, a boolean
    Column over ``name``, or a table with the names in its column ``name``) pay
    ``reduced_rate``, all others ``standard_rate``."""

    reduced: Sequence[str] | Column | DataFrame = REDUCED_VAT_NAMES
    reduced_rate: int = REDUCED_VAT_RATE
    standard_rate: int = STANDARD_VAT_RATE


@dataclass(frozen=True)
class CostModel:
    """Daily costs by calendar month (any year); months without a tariff give NULL."""

    tariffs: Mapping[int, tuple] = field(default_factory=lambda: dict(TARIFFS))
    bonus_min_orders: int = BONUS_MIN_ORDERS


@dataclass(frozen=True)
class Folding:
    threshold: Decimal = OTHER_THRESHOLD
    label: str = OTHER_LABEL
