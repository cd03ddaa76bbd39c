"""Registered queries beside their SQL twins on the smallest tables; skipped where the tables are missing."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.check_queries import compare_rows, connect

FOLDER = "/root/testdata/sf0.001"
SLOW = ("cross_validated", "two_phase", "models_", "importances", "calibrator_fitted", "all_feature", "streamed", "tree_shap", "wide")

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not any(s in n for s in SLOW)])
def test_query_matches_its_twin(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    ok, note = compare_rows(df, con, name)
    assert ok, note


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
