"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "q_learning_curve", "q_running_best", "q_extended_curve", "q_stop_plateau_10", "q_stop_global_best_10",
    "q_plateaus", "q_stitch", "q_stop_summary", "q_best_per_run", "q_method_summary", "q_rank", "q_describe",
    "q_param_stats", "q_fold_metrics", "q_objective_sql", "q_kfold_contiguous", "q_hist_split", "q_propose_tpe",
    "q_live_stop", "q_boost_stump_cv", "q_boost_cv", "q_propose_ei", "q_search_runs_cut", "q_rank_ties",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from trialwright.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["q_learning_curve"](spark, sf_dir).collect()  # start the JVM's compilers and the Python workers
    QUERIES["q_default_config"](spark, sf_dir).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
