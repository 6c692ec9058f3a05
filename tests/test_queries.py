"""Every core query against its SQL; those without SQL must run and have a stable schema."""

import pytest

from lorewell.plans import registry
from tests.oracle import DATA, compared

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, name):
    assert compared(spark, name, QUERIES[name], SQL[name], f"{DATA}/sf0.001") is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    assert df.schema == QUERIES[name](spark, f"{DATA}/sf0.001").schema
    assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
