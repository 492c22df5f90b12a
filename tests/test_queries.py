"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from workload import QUERIES, SQL

from .compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER), con, SQL[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql())


def test_entry(spark):
    rows = entry(spark)
    assert rows.count() > 0
    assert rows.columns == ["id", "title", "published_date", "feed_name", "completed_at", "summary_path"]
