import pytest

from tests.comparing import connection, same
from textquarry import queries, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    assert name in MAY_BE_EMPTY or con.sql(registry.ORACLES[name]).fetchall()
    same(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name])


#: Queries whose SQL finds no row in the smallest table, or in any.
MAY_BE_EMPTY = {"kw_fallback", "reference_like"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_finds_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_oracles_are_queries():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
