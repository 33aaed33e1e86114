"""Plan properties of every registered query: no Python UDF, no Cartesian
product, filters reach the Parquet scan."""

import pytest

from branchdata.plans.registry import builders
from conftest import SF001

_SIDE_EFFECTS = {"snapshot_load", "snapshot_all", "clone_branch", "create_branch", "mask_leak_check",
                 "audit_export", "resumable_load", "stream_progress", "activity_stream"}
NAMES = sorted(n for n in builders() if n not in _SIDE_EFFECTS)


@pytest.mark.parametrize("name", NAMES)
def test_plan_is_jvm_only_and_has_no_cartesian(spark, name):
    df = builders()[name](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{name}: {bad}"


def test_filters_pushed_to_scan(spark):
    plan = builders()["extract_subset"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), IsNotNull(o_totalprice), EqualTo(o_orderstatus,F)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double" in plan


def test_keyset_page_pushes_first_key(spark):
    plan = builders()["keyset_page"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(conv_id,20)" in plan
