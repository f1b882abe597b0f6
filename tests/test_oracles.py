"""Every registered query against its SQL twin."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, difference

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_every_sql_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(SQL))
def test_equals_sql(spark, sf, key):
    assert difference(QUERIES[key](spark, sf), connect(sf), SQL[key]) is None


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, key):
    assert QUERIES[key](spark, sf).count() > 0
