"""Write PLANS.md: the physical operator tree and scan facts of the headline queries (sf0.01)."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

HEADLINE = ["band_share", "daily_mean", "interp_time", "lag_features", "rolling_30", "decompose_365", "describe",
            "box_stats", "corr_matrix", "kde", "regression_metrics", "dim_join", "date_range", "ar1_forecast"]


def tree_and_facts(df) -> tuple[str, dict]:
    text = df._jdf.queryExecution().executedPlan().toString()
    tree = "\n".join(line for line in text.splitlines() if line.strip())
    facts = {
        "exchanges": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)", tree)),
        "broadcast_exchanges": tree.count("BroadcastExchange"),
        "joins": len(re.findall(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin)", tree)),
        "windows": len(re.findall(r"\bWindow \[", tree)) or tree.count("Window "),
        "python_udfs": len(re.findall(r"(ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas)", tree)),
        "cartesian": tree.count("CartesianProduct") + tree.count("BroadcastNestedLoopJoin"),
    }
    return tree, facts


def main() -> None:
    from panelstack.plans.registry import queries
    from panelstack.session import get_spark

    sf_dir = os.environ.get("PLAN_SF_DIR", "/root/testdata/sf0.01")
    spark = get_spark("local[8]", 16)
    qs = queries()
    out = ["# PLANS — physical plans of the headline queries", "",
           f"Generated by `python tests/dump_plans.py` on `{sf_dir}` (initial adaptive plan, before runtime "
           "re-optimisation). Counts: shuffle exchanges, broadcast exchanges, joins, window operators, Python "
           "evaluation nodes, cartesian/nested-loop joins.", ""]
    out.append("| query | exchanges | broadcasts | joins | python nodes | cartesian |")
    out.append("| --- | ---: | ---: | ---: | ---: | ---: |")
    trees = []
    for name in HEADLINE:
        tree, f = tree_and_facts(qs[name](spark, sf_dir))
        out.append(f"| {name} | {f['exchanges']} | {f['broadcast_exchanges']} | {f['joins']} | {f['python_udfs']} | {f['cartesian']} |")
        scans = re.findall(r"FileScan parquet [^\n]*", tree)
        trees.append((name, tree, scans))
    out.append("")
    for name, tree, scans in trees:
        out += [f"## {name}", "", "```", tree[:6000], "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))


if __name__ == "__main__":
    main()
