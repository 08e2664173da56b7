"""Every registered query runs; those with SQL give what the SQL gives."""

import pytest

import __spark_entry__ as contract
from checks.compare import compare, connect

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf):
    return connect(sf)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, connection, name):
    assert compare(QUERIES[name](spark, sf), connection, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_gives_rows(spark, sf, name):
    assert not QUERIES[name](spark, sf).isEmpty()


def test_entry(spark):
    assert contract.entry(spark).count() == 23
