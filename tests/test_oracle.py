"""Every registered query beside its SQL twin, and its plan."""

import re

import pytest
from conftest import SF

import __spark_entry__ as entry
from compare import compare

# queries over text corpora have their own tests
QUERIES, ORACLE = ({k: v for k, v in d.items() if k != "pipeline" and not re.match(r"op\d+_", k)}
                   for d in (entry.queries(), entry.oracle_sql()))
# queries whose core is a matrix product in numpy
PYTHON_CORE = {"semantic_search", "semantic_search_by_category", "build_context"}
# queries that hand back the outcome of a trained model
TRAINED = re.compile("train_|score_|forecast_.*recursive|feature_importance|fit_.*calibrator|hashed_vectors")


def check_plan(name, df):
    """No row-at-a-time Python, no pairing of everything with everything."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert name in PYTHON_CORE or "MapInPandas" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if not TRAINED.search(name):
        check_plan(name, df)
    if name in ORACLE:
        assert compare(df, duck, ORACLE[name]) in ("EXACT", "CLOSE")
    else:
        assert df.count() > 0


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "month_key" and df.count() > 0
