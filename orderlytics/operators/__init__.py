from orderlytics.operators import cohorts, costs, daily, facts, shares, windows  # noqa: F401
