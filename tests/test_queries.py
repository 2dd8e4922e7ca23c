from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_points
from postlake.queries import QUERIES
from postlake.queries_sql import SQL
from tests.compare import connect, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(SQL) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(QUERIES) <= set(entry_points.queries())


@needs_data
@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    want = connect(SF_DIR).execute(SQL[name]).df()
    assert difference(got, want) is None


@needs_data
def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
