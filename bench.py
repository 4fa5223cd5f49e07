"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Prints ONE JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed in full with a ``noop`` write (every row produced,
nothing shipped to the driver).  One untimed warm-up job (a scan, an
aggregate and an Arrow/Python stage) runs first so the first timed query does
not carry JVM and Python-worker start-up.  Set BENCH_QUERIES=a,b to run a
subset.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "first_child_left_join", "drop_audit", "lump_topn", "impute_mean", "feature_matrix_long",
    "skew_check", "corr_matrix", "yeo_johnson_fitted", "ols_two_feature", "wls_simple",
    "ols_full_coefs", "linear_cv_r2", "interaction_coefs_all_depths", "pca_top_contributors",
    "param_rollup", "forest_metrics", "tree_shap_importance", "tree_pdp_2d", "perm_importance",
    "summary_facts",
]


def _warm_up(spark, sf_dir: str) -> None:
    import pandas as pd
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{sf_dir}/region.parquet")
    df.groupBy("r_name").agg(F.count(F.lit(1))).collect()
    df.mapInPandas(lambda it: (pd.DataFrame({"n": [len(p)]}) for p in it), "n long").collect()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    from trendlens.plans.catalog import QUERIES
    from trendlens.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=max(8, int(cpus) * 2))
    spark.conf.set("spark.trendlens.partitions", str(2 * int(cpus)))  # the tables are one file each
    _warm_up(spark, sf_dir)
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
