"""Every registered query that SQL can express agrees with DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not there")


def test_registration():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, name):
    said = compare(entry.queries()[name](spark, FOLDER), duck(FOLDER), entry.oracle_sql()[name], tolerant=True)
    assert said == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
