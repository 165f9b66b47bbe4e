"""Joins of statements with methods, whatever the tables' sizes."""

from patchloom import plans
from patchloom.plans import base

SF = "/root/testdata/sf0.001"


def test_statements_are_dealt_over_more_tasks_on_larger_tables(spark, monkeypatch):
    rows = base.read(spark, SF, "lineitem").count()
    monkeypatch.setattr(base, "DEALT", rows // 9)
    for name in ("union_predictions", "rollup_max", "attach_method_meta"):
        plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        # no table is whole in a task, and what is dealt by method once is grouped as it is
        assert plan.count("BroadcastHashJoin") <= (name == "attach_method_meta"), plan
        assert "hashpartitioning(l_orderkey" in plan and ", 10)" in plan and "hashpartitioning(method_id" not in plan
