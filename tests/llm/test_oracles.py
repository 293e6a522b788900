"""The corpus queries beside their oracles; those without one are held against brute force in the other files."""

import pytest

from tests.compare import connect, difference
from tidemark.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_oracle(spark, con, name):
    assert difference(queries.QUERIES[name](spark, FOLDER), con, queries.ORACLES[name]) is None


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


NATIVE = ["op2_quality_rules", "op3_mixing", "op5_chat_formatting", "op7_url_filter"]


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_hold_no_python(spark, name):
    plan = queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
