"""Every query with SQL against DuckDB, every other one for a stable schema and rows."""

import os

import pytest

from graphloom.plans.catalog import FLAGSHIP, ORACLE, QUERIES
from tests.oracle import connect, rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
#: Slow estimators: once is enough, on the smallest tables.
NEVER_EMPTY = {n for n in QUERIES if not n.startswith(("v", "l13", "l8"))}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_run(spark, name):
    out = QUERIES[name](spark, SF)
    first = out.count()
    assert first > 0 and out.columns == QUERIES[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__ as e

    assert FLAGSHIP in e.queries() and e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
