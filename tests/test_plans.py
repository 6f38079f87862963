"""Plan-shape checks over the registered queries (built on sf0.001, inspected, not collected)."""

from tests.conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def test_no_cartesian_or_nested_loop_joins(spark):
    """Every relational query, and of the learners those that fit in seconds; streams return the read of a sink."""
    import __spark_entry__ as e

    from panelstack.plans.registry import REGISTRY
    q = e.queries()
    bad = {}
    for name in sorted([n for n in REGISTRY if REGISTRY[n].sql and n != "daily_run"] + ["cv_evaluate", "ridge_score", "tree_regressor", "top_features"]):
        plan = q[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        hits = [f for f in FORBIDDEN if f in plan]
        if hits:
            bad[name] = hits
    assert not bad, bad


def test_panel_scan_is_pruned_and_grid_needs_no_join(spark):
    from panelstack.plans.panels import p2_filled
    plan = p2_filled(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>" in plan
    assert "Join" not in plan
    # partial aggregate exchange on (series, day) + one exchange on the series key for every window
    assert plan.count("Exchange hashpartitioning") == 2


def test_date_filter_reaches_scan(spark):
    import __spark_entry__ as e
    plan = e.queries()["date_range"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
