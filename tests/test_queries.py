"""Every registered query against its SQL twin, and what its plan must not hold."""

import pytest

import __spark_entry__ as contract
from tallyframe.plans import ORACLES, QUERIES
from tests.conftest import SMALL
from tests.oracle import connect, difference


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, duck, key):
    df = QUERIES[key](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "ArrowEval" not in plan
    assert difference(df, duck, ORACLES[key]) is None


def test_only_models_have_no_sql():
    assert set(QUERIES) - set(ORACLES) == {
        "churn_scores", "churn_importance", "churn_report", "user_segments", "segment_summary", "segment_counts", "prediction_rows",
    }


def test_contract_holds_them_all():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["period", "revenue", "cumulative"]
    assert df.count() > 0
