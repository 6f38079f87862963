"""Benchmark: wall-clock of the headline plans and of the learners on one scale factor.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS
(default 3; headline times are medians), BENCH_ALL=1 (adds the slowest learners).
Each query is fully materialised with the ``noop`` sink (no driver collect).
Prints one JSON line; ``value`` is the sum of the headline medians, the learners
(one run each) stand under ``learners``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["daily_mean", "band_share", "interp_time", "feature_panel", "corr_matrix", "decompose_365",
            "describe", "kpis", "ar1_forecast", "histogram_30", "regression_metrics", "stream_daily_mean"]
LEARNERS = ["kde", "ridge_score", "tree_regressor", "cv_evaluate", "rf_classifier", "score_latest", "daily_run"]
SLOWEST = ["forest_regressor", "boosted_regressor", "boosted_classifier", "grid_search"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from panelstack.plans.registry import queries
    from panelstack.session import get_spark

    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus * 2, app_name="panelstack-bench")
    qs = queries()

    def seconds(name: str) -> float:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    seconds("daily_mean")  # warm-up: JVM start, code generation of the scan path
    times = {name: round(statistics.median(seconds(name) for _ in range(runs)), 3) for name in HEADLINE}
    learners = {name: round(seconds(name), 3) for name in LEARNERS + SLOWEST * (os.environ.get("BENCH_ALL") == "1")}
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "headline_total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "learners": learners, "runs": runs, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
