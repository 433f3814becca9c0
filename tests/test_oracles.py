"""Every registered query against its SQL in DuckDB."""

import oracle
import pytest
from conftest import DATA

from sluice.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return oracle.connection(DATA)


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got, want = oracle.compare(spark, con, DATA, QUERIES[name], SQL[name])
    assert got == want


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
