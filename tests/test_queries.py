"""Every registered query of the alert side agrees with its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from siftwell.plans.queries import QUERIES, SQL

from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(name, spark, duck, same):
    same(QUERIES[name](spark, SMALL), duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
