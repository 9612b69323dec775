"""Registered queries against their SQL twins; the rest have tests of their own against plain versions."""

import pytest

import __spark_entry__ as contract
from tests.conftest import SMALL
from tests.oracle import connect, difference

QUERIES, ORACLES = contract.LLM_QUERIES, contract.LLM_ORACLES
NATIVE = ("op4_chat", "op5_source_mix", "op7_pii", "op9_sharding", "op10_url_verdicts")


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_all_are_registered():
    assert sorted(int(k.split("_")[0][2:]) for k in QUERIES if k != "pipeline") == [*range(1, 14)]
    assert "pipeline" in QUERIES and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, duck, key):
    assert difference(QUERIES[key](spark, SMALL), duck, ORACLES[key]) is None


@pytest.mark.parametrize("key", NATIVE)
def test_native_plans(spark, key):
    plan = QUERIES[key](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_columns_of_the_contract(spark):
    want = {
        "op1_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        "op2_fingerprint": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        "op3_language": ["doc_id", "held_out", "lang_pred", "score"],
        "op6_simhash": ["doc_id", "fingerprint", "component_id"],
    }
    for key, columns in want.items():
        df = QUERIES[key](spark, SMALL)
        assert df.columns == columns
        if key != "op1_packing":
            assert df.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
