import pytest

from factorloom.llm.queries import ORACLES, QUERIES

from ..conftest import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    same(QUERIES[name](spark, sf), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0
