"""Every registered query runs, those without SQL included (their plans as well keep to the execution rules)."""

import pytest

from conftest import SF001
from test_plan_rules import FORBIDDEN_NODES


def _without_sql():
    import __spark_entry__ as E
    return sorted(set(E.queries()) - set(E.oracle_sql()))


@pytest.mark.parametrize("name", _without_sql())
def test_query_without_sql_runs(spark, name):
    import __spark_entry__ as E
    from surveylab.plans.catalog import REGISTRY
    df = E.queries()[name](spark, SF001)
    assert df.columns and len(df.collect()) > 0
    if name in REGISTRY:  # the text operators may use Python
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [n for n in (*FORBIDDEN_NODES, "MapInArrow") if n in plan]
