"""Every registered query against its check SQL."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry_points

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
# queries of an optional folder have their own tests
QUERIES = {n: q for n, q in entry_points.queries().items() if n not in entry_points.LLM_QUERIES}
SQL = {n: q for n, q in entry_points.oracle_sql().items() if n not in entry_points.LLM_SQL}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, SQL[name]) == []


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["Generation", "Sex", "EduMaxLbl", "MarEver", "n", "MarProp"]
    assert df.count() > 0
