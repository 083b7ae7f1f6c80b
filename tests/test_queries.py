"""Every registered query against its SQL."""

import pytest
from compare import compare, connect
from conftest import SF

import __spark_entry__ as contract
from wardlight.catalog import build_registry

REGISTRY = build_registry()
QUERIES, SQL = REGISTRY.queries, REGISTRY.sql
ROWS_ONLY = {"b1_design_random_rows"}
VECTORISED = {"b2_vector_quantiles"}  # a function of the user's own runs in Python


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    text = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert node not in text or node == "ArrowEvalPython" and name in VECTORISED
    assert compare(df, con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_random_queries_have_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_only_random_queries_lack_sql():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["siminputrow", "month", "rate"]
    assert df.count() > 0
