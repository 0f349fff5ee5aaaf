"""Every query with a SQL twin gives the same rows; the others give some."""

import pytest
from check_oracles import compare, connect

from permeon.plans.catalog import load

QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, spark, data, con):
    assert compare(QUERIES[name](spark, data), con, ORACLES[name]) is None


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark, data):
    import __spark_entry__ as entry

    assert entry.queries().keys() >= QUERIES.keys()
    assert entry.oracle_sql().keys() >= ORACLES.keys()
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0
