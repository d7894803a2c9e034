"""Every query with SQL against DuckDB on the smallest tables."""

import pytest

from tests.check import compare, connect
from tests.conftest import SMALL
from __spark_entry__ import oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_check_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    problem, _ = compare(QUERIES[name](spark, SMALL), con, SQL[name])
    assert problem is None, problem
