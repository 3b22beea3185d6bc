"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
input and the local cores. BENCH_ALL=1 times every registered query. Times are cold: no query
reads a table that an earlier one staged.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tremor.plans import load_all  # noqa: E402
from tremor.session import forget_staged, local_session  # noqa: E402

HEADLINE = [
    "q0_forward_outcomes", "j01_origin_session", "j02_snapshot_asof", "j07_align_factor", "e06_event_outcomes", "e04_recovery_time",
    "w04_exponential_means", "w08_volume_block", "e07_market_model", "e08_e09_abnormal_returns", "e10_stage_a_expected", "e15_series_event_panel",
    "a02_loss_features", "a03_hazard_features", "v03_v05_v06_cross_section", "v07_v09_event_study_table", "v12_randomisation_test",
    "c01_fold_membership", "c03_purge", "l01_ridge_inner_cv", "l06_l11_grid_ablation", "m01_a12_regression_metrics", "m04_f09_roc_auc",
    "b09_b10_b11_verdicts", "b05_cluster_auc_bootstrap", "b12_label_permutation", "b16_robustness_suite", "d01_kaplan_meier", "d05_j20_harrell_c",
    "d07_integrated_brier", "b06_c_index_bootstrap", "q01_spearman_pairs", "q08_stationarity", "c08_j18_interpolated_rows", "l02_l03_l04_mllib_regressors",
    "d11_weibull_aft", "j19_v04_all_pairs", "c08_all_columns", "l06_l11_information_grid",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_all()
    names = list(queries) if os.environ.get("BENCH_ALL") else HEADLINE
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the engine outside the timings
    times = {}
    for name in names:
        forget_staged()  # every query pays for the tables it stages
        t0 = time.perf_counter()
        try:
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # a failed query is reported, not hidden
            times[name] = None
            print(f"{name}: {type(e).__name__} {str(e)[:300]}", file=sys.stderr)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    total = sum(t for t in times.values() if t is not None)
    print(json.dumps({"metric": "headline_total" if names is HEADLINE else "all_total", "value": round(total, 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
