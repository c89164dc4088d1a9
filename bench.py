"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the
local threads, BENCH_QUERIES an optional comma-separated choice of queries.  Every query is
written to the no-op sink, so all columns of all rows are computed; the better of two runs
counts.
"""

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postloom.registry import QUERIES  # noqa: E402

HEADLINE = [
    "preprocess_posts", "strip_markup_pages", "impurity_top10_clean", "word_count_describe", "token_counts",
    "enrich_left_join", "random_split", "sample_train", "tokenize", "hashed_embedding",
    "assign_clusters", "knn_topk", "classify_clustered", "accuracy_macro", "knn_graph", "fuzzy_graph",
    "group_mean", "group_medoid", "cluster_prototypes", "prototype_search", "prototypical_classify",
    "cluster_recall_density", "cluster_quality", "majority_info", "few_shot_episodes",
    "fit_clusters", "classify_zero_shot", "category_classifier", "prepare_posts", "prepare_embeddings",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("postloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["hash_split"](spark, sf_dir).count()
    times = {}
    for name in names:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(found.group(1)) if found else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
