"""The queries that SQL can express, beside their SQL."""

import os

import pytest
from compare import differences

from fabula.llm import queries

FOLDER = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    assert differences(spark, FOLDER, queries.queries()[name], SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_runs(spark, name):
    queries.queries()[name](spark, FOLDER).count()
