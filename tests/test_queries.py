"""Every registered query against its SQL check, and what its plan must not hold."""

import pytest
from compare import compare, connect
from conftest import SMALL

from workload.all import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    assert compare(spark, duck, QUERIES[name], ORACLES[name], SMALL) is None


PYTHON_ALLOWED = {"review_confidence", "review_status", "average_confidence", "record_list"}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_plan_has_no_cross_join_and_no_python(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan
    assert ("ArrowEvalPython" in plan) == (name in PYTHON_ALLOWED)


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
