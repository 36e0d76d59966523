"""Every query with SQL gives the rows that DuckDB gives."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF_DIR), entry.oracle_sql()[name], con) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = entry.queries()[name](spark, SF_DIR)
    rows = df.count()
    assert df.columns and rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
