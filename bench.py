"""Headline timings; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "derived_pooled", "library_search", "ri_band_search", "cosine_neighbours", "weighted_cosine_neighbours", "composite_neighbours",
    "entropy_weighted_neighbours", "wasserstein_neighbours", "ppm_wasserstein_neighbours", "rerank_topk",
    "sparse_bin_search", "lc_candidate_audit", "lc_search", "order_neighbours_ppm", "replicate_consistency",
    "precision_at_k", "auc_roc", "analog_graph", "cluster_drivers", "quant_pipeline", "msp_parse",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from peakloom.plans.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", str(4 * int(cpus))).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "14g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    QUERIES["capped_sample"](spark, sf_dir).count()  # start the JVM and workers
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
