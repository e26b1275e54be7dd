from orderlytics.sources.params import Campaigns, CostModel, Folding, VatRule  # noqa: F401
from orderlytics.sources.tables import Shop, conform  # noqa: F401
