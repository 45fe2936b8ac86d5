"""Plan audit: no registered query may plan a cartesian product, a
nested-loop join or a row-at-a-time Python UDF, and scans must be pruned."""

import pytest

from conftest import SF_SMALL
from stanceflow.plans.queries import QUERIES

MODEL_KEYS = {"train_classifier", "score_classifier", "two_head", "joint_two_head"}   # fit at construction time
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "RoundRobinPartitioning")


@pytest.mark.parametrize("key", sorted(set(QUERIES) - MODEL_KEYS))
def test_plan_has_no_forbidden_operators(spark, key):
    df = QUERIES[key](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [f for f in FORBIDDEN if f in plan], plan[:2000]


def test_metric_scan_is_pruned(spark):
    df = QUERIES["f1_per_target"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan
    assert "text" not in plan.split("documents.parquet")[0].split("FileScan")[-1]
