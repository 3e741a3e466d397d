"""Every registered query against its SQL counterpart on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, queries
from tallyman.plans.queries import ORACLE, QUERIES
from tools.check_queries import compare, connect

@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_all_are_registered():
    assert set(QUERIES) <= set(queries())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, sf_dir, name):
    same, note = compare(QUERIES[name](spark, sf_dir), con, ORACLE[name])
    assert same, note


def test_entry(spark):
    assert entry(spark).columns == ["county_id", "orders", "revenue", "average_total", "items"]
