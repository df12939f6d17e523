"""The registry is whole and the flagship query runs."""

import __spark_entry__ as entry


def test_registry():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert len(queries) > 100


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
