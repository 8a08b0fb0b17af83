"""Every named query against its SQL; queries without SQL must run and give rows."""

from __future__ import annotations

import os

import pytest
from oracle import compare, connect

from __spark_entry__ import ENTRY_DIR, entry, oracle_sql, queries

SF = os.environ.get("ORACLE_SF_DIR", ENTRY_DIR)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


PYTHON = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "AggregateInPandas", "WindowInPandas")
WITH_PYTHON = {"udaf_custom_encoder", "scale_quantile_uniform", "scale_quantile_normal"}
FITTING = {n for n in queries() if n.startswith("model_")} - {"model_feature_assembly"}


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df, sql = queries()[name](spark, SF), oracle_sql().get(name)
    if name not in FITTING:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert name in WITH_PYTHON or not any(p in plan for p in PYTHON)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if sql is None:
        assert df.collect()
    else:
        problems, _ = compare(df, con, sql)
        assert not problems


def test_entry(spark):
    assert entry(spark).count() == 1000


def test_oracle_names_are_queries():
    assert set(oracle_sql()) <= set(queries())
