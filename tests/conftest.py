from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from orderlytics.session import get_session  # noqa: E402
from orderlytics.sources.tables import (COURIER_ACTIONS, ORDERS, PRODUCTS,  # noqa: E402
                                        USER_ACTIONS, Shop)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_session(app="orderlytics-tests", master="local[*]", shuffle_partitions=8)
    yield s
    s.stop()


def ts(day: int, hour: int = 10, minute: int = 0, month: int = 9, year: int = 2022) -> dt.datetime:
    return dt.datetime(year, month, day, hour, minute)


def money(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def micro_shop(spark, actions, orders, products, couriers=()) -> Shop:
    """A shop from literal rows in canonical column order."""
    return Shop(
        spark.createDataFrame(list(actions), USER_ACTIONS),
        spark.createDataFrame(list(orders), ORDERS),
        spark.createDataFrame([(p, n, money(v)) for p, n, v in products], PRODUCTS),
        spark.createDataFrame(list(couriers), COURIER_ACTIONS),
    )


def rows(df, *cols):
    """Collected rows as tuples (in the given column order), sorted; decimals as floats."""
    cols = cols or tuple(df.columns)
    return sorted((tuple(float(r[c]) if isinstance(r[c], Decimal) else r[c] for c in cols) for r in df.collect()),
                  key=lambda t: tuple((x is None, str(x)) for x in t))
