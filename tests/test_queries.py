"""Every registered query with a SQL twin agrees with it on the smallest scale; the rest at least run."""

import os

import pytest

from prefspark.plans import load_all
from tests.oracle import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
REGISTRY = load_all()
WITH_SQL = [n for n, q in REGISTRY.items() if q.sql is not None]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return connect(SF_DIR)


@pytest.mark.parametrize("name", WITH_SQL)
def test_agrees_with_sql(spark, duck, name):
    line = compare(spark, duck, SF_DIR, REGISTRY[name])
    assert line.startswith("ok"), line


def test_plans_have_no_nested_loop_over_tables(spark):
    """Any-key matching and the as-of rules are equi joins."""
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    for name in ("multi_key_dedupe_join", "dedupe_keep_newest", "asof_freshness", "token_score_join", "similar_topk_join"):
        plan = REGISTRY[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name
