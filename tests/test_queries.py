"""Every registered query runs; those with SQL equal DuckDB on the same tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, sf, duck, name):
    assert difference(QUERIES[name](spark, sf), duck, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    found = QUERIES[name](spark, sf)
    assert found.columns and len(set(found.columns)) == len(found.columns) and not found.isEmpty()
