import pytest
from helpers import SMALL, assert_same, duck

import __spark_entry__ as entry
from sessionmill.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, con, name):
    assert_same(QUERIES[name](spark, SMALL), con, ORACLE_SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
