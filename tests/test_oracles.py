"""Every registered query beside its oracle, on the smallest tables."""

import pytest

from tests.compare import connect, difference
from tidemark.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_equals_oracle(spark, con, name):
    assert difference(catalog.QUERIES[name](spark, FOLDER), con, catalog.ORACLES[name]) is None


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLES])
def test_query_without_oracle_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert {r["status"] for r in entry.entry(spark).collect()} >= {"OK", "MISSING_TAG"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
