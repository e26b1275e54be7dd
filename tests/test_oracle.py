"""Every registered query equals its DuckDB oracle (rows, columns, types,
values) on the smallest test scale; ``tools/check_oracle.py`` runs the same
check at sf0.01."""

from __future__ import annotations

import pytest

from conftest import SF_SMALL
from orderlytics.plans import registry, verify

QUERIES = registry.queries()
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return verify.duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = verify.compare(QUERIES[name](spark, SF_SMALL), ORACLE[name], con)
    assert res["ok"], res


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "dt"
