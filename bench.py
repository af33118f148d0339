"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_QUERIES an optional comma list.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dyadic.plans.catalog import QUERIES  # noqa: E402
from dyadic.session import local_session  # noqa: E402

HEADLINE = [
    "pairs_load_regression", "pairs_load_aliased", "pairs_load_binary", "pairs_last_write", "marginal_means",
    "split_random", "split_cold_a", "grid_densify_zero", "char_hash_features", "ngram_hash_features", "feature_prior",
    "topk_neighbors", "cosine_all_pairs", "cosine_cross_shifted", "rank_average", "metric_spearman",
    "metric_concordance", "evaluate_regression", "evaluate_binary", "predict_simple", "predict_dual_view", "predict_mf",
    "mixhop_predict", "predict_cross_attention", "predict_char_encoder", "perturb_pairs", "reliability_score",
    "masked_reconstruction", "env_risk_variance", "irm_cf_score", "report_aggregate", "dedupe_latest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES")
    names = HEADLINE if not names else list(QUERIES) if names == "all" else names.split(",")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "dyadic-bench")
    spark.read.parquet(f"{folder}/region.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
