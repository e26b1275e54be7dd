"""Order-service unit economics and marketing metrics as Spark DataFrame operators.

Layers:
  sources    canonical tables (`Shop`), parameters, adapters over the test tables
  functions  Column helpers (money, exact ratios, day names, labels)
  operators  reusable building blocks (valid orders, order lines, daily aggregates, cohorts, ...)
  plans      the thirteen metric queries and their registry
  llm        operators for training text (optional; nothing else imports it)
"""

from orderlytics.session import get_session, ensure_checkpoint_dir  # noqa: F401
from orderlytics.sources.tables import Shop  # noqa: F401
