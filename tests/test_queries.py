import pytest

from fathom.plans import registry
from tests.oracles import same_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    same_rows(spark, registry.QUERIES[name], registry.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_top_k_plans_limit_groups_before_the_shuffle(spark):
    plan = registry.QUERIES["bm25_batch_queries"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
