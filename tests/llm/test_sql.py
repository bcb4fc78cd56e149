"""Registered queries against their check SQL."""

import pytest
from compare import compare, connect

from cohortlens.llm import queries, sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sql.SQL)
def test_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), sql.SQL[name]) == []
