"""The registered queries against their SQL."""

import pytest
from compare import compare, connect
from conftest import SMALL

from fieldmill.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, connect(SMALL), QUERIES[name], ORACLES[name], SMALL) is None


def test_entry_has_all_queries():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)} and QUERIES.keys() | {"pipeline"} <= names
