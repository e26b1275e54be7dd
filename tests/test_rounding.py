"""The numeric contract: Spark's decimal ratios and the oracle's integer-cent
rounding both equal exact half-away-from-zero rounding of the true quotient,
on random pairs that include many ties."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import duckdb
import numpy as np

from orderlytics.functions import percent, ratio
from orderlytics.plans.oracle import r2


def _pairs(n=4000, seed=5):
    rng = np.random.default_rng(seed)
    num = rng.integers(-10**9, 10**9, n)
    den = rng.integers(1, 10**6, n)
    # ties at the third decimal: num / den = k + 0.005 exactly
    k = rng.integers(-10**6, 10**6, n // 4)
    num[: n // 4] = k * 200 + 1
    den[: n // 4] = 200
    return [(int(a), int(b)) for a, b in zip(num, den)]


def _exact(n, d, scale=1):
    return float((Decimal(n) * scale / Decimal(d)).quantize(Decimal("0.01"), ROUND_HALF_UP))


def test_spark_ratio_and_percent_round_exactly(spark):
    pairs = _pairs()
    df = spark.createDataFrame(pairs, "n BIGINT, d BIGINT")
    got = df.select(ratio("n", "d").cast("double").alias("r"),
                    percent("n", "d").cast("double").alias("p")).collect()
    for (n, d), row in zip(pairs, got):
        assert row.r == _exact(n, d), (n, d, row.r)
        assert row.p == _exact(n, d, 100), (n, d, row.p)


def test_oracle_rounding_is_exact():
    pairs = _pairs(seed=9)
    con = duckdb.connect()
    con.execute("CREATE TABLE t (n BIGINT, d BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", pairs)
    got = con.sql(f"SELECT n, d, {r2('n', 'd')} AS r FROM t").fetchall()
    for n, d, r in got:
        assert r == _exact(n, d), (n, d, r)
