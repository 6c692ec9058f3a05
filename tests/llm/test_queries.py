import pytest

from lorewell.llm.queries import QUERIES, SQL
from tests.oracle import DATA, compared


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, name):
    assert compared(spark, name, QUERIES[name], SQL[name], f"{DATA}/sf0.001") is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() >= 0
