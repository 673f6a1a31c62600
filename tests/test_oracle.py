"""Every registered query against its SQL on the smallest data folder."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as registry


@pytest.fixture(scope="module")
def con(sf):
    with oracle.connect(sf) as connection:
        yield connection


def test_each_query_has_sql():
    """Each query of the shop's tables; the corpus operators have tests of their own."""
    assert set(registry._REGISTERED) <= set(registry.oracle_sql())
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", list(registry._REGISTERED))
def test_query(spark, sf, con, name):
    rows, problem = oracle.compare(
        registry.queries()[name](spark, sf), con, registry.oracle_sql()[name]
    )
    assert problem is None, problem
    assert rows > 0


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns == ["category", "revenue", "share"]
    assert df.count() == 6
