"""Benchmark: headline queries on ``$BENCH_SF_DIR`` (default sf0.1) with
``local[$BENCH_CPUS]``.  Prints ONE JSON line.

The headline set is the reference's EDA + quality + feature + monitoring
work (its published figure: 16.4 s for the 7-module EDA on 10,000 rows)
plus one cross-validated model.  Every query is executed completely with the
``noop`` sink (no collect to the driver).  Two passes over the same tables:
the first ("cold") pays JVM JIT and whole-stage-codegen compilation of every
plan; the second ("warm") is the steady-state figure reported as ``value``.
Both are in the JSON line.  Nothing is cached between passes (every query
re-reads its Parquet input; intermediates persisted inside a query are
released or recomputed).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "ag01_table_profile", "ag02_describe", "ag07_correlation_matrix", "ag10_pivot_label_rate",
    "ag11_interaction_curve", "ag13_anova", "ag14_chi2", "ag15_normality", "fe11_qcut",
    "fe13_feature_table", "qc08_run_suite", "qc11_split_valid", "sp03_stratified_folds",
    "wn02_assign_batches", "mt02_binary_metrics", "mt04_roc_curve", "mo01_batch_metrics",
    "cv01_cross_validate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tessera.session import get_session
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                        conf={"spark.sql.files.maxPartitionBytes": str(64 << 20)})
    from tessera.plans import QUERIES

    def run(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    cold = {q: round(run(q), 3) for q in HEADLINE}
    spark.catalog.clearCache()
    times = {q: round(run(q), 3) for q in HEADLINE}
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(cpus), "cold_total": round(sum(cold.values()), 3), "queries_cold": cold}))


if __name__ == "__main__":
    main()
