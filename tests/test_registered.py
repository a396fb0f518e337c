"""Every registered query against its SQL counterpart on the smallest tables."""

from __future__ import annotations

import pytest
from compare import connect, difference

from __spark_entry__ import entry, oracle_sql, queries
from tremorlake.plans.queries import all_queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    """The optional subpackage names its own exceptions in its tests."""
    assert set(all_queries()) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns[:2] == ["tick", "t_us"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    problem, rows, _ = difference(spark, con, queries()[name], oracle_sql()[name], SF_DIR)
    assert problem is None
    assert rows > 0
