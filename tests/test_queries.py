"""Every query that has SQL gives the same rows as DuckDB; the others give rows."""

import os

import pytest
from oracle_compare import both

from quern.plans import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    _, got, want = both(spark, QUERIES[name], ORACLE_SQL[name], SF)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 7
    assert set(e.oracle_sql()) <= set(e.queries())
