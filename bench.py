"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (sum of per-query seconds), "unit",
"queries": {name: seconds}, "sf"}.  Each query is fully materialised with
the ``noop`` sink (no collect).  One warm-up pass, then the median of
$BENCH_REPEATS (default 3) timed runs per query.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "profile_columns", "profile_overview", "top_values_orders", "correlation_pairs",
    "impute_median", "scale_robust", "encode_target", "outlier_iqr", "select_anova_f", "interpolate_linear",
    "metric_binary_classification", "metric_roc_auc_binary", "metric_regression", "roc_pr_curve", "paired_ttest",
    "drift_psi_events", "fair_equalized_odds", "recommend_top5",
    "grid_search_ridge", "bootstrap_ci", "explain_top_drivers", "explain_what_if",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    from tabsmith.session import get_spark
    from tabsmith.plans.catalog import load_all
    spark = get_spark(f"local[{cpus}]", app="tabsmith-bench", shuffle_partitions=int(cpus) * 2)
    queries, _ = load_all()
    names = [q for q in HEADLINE if q in queries]
    only = os.environ.get("BENCH_ONLY")
    if only:
        names = [q for q in names if re.search(only, q)]

    def run(name):
        spark.catalog.clearCache()          # no run reads what another has cached
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for n in names:          # warm-up: JIT, file listing caches
        run(n)
    times = {n: round(statistics.median(run(n) for _ in range(repeats)), 3) for n in names}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None}))


if __name__ == "__main__":
    main()
