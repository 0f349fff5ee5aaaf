"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is computed in full into a discarding sink. ``rows_per_sec`` relates
the time to the rows the query answers for: all rows of its main table, or the
held-out fifth where it fits a model or searches neighbours for that part only.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from permeon.plans.catalog import load  # noqa: E402
from permeon.session import local_session  # noqa: E402

HELD_OUT = 0.2
# Query and the table whose rows it works through.
HEADLINE = {
    "scored_batch_summary": "events",
    "ensemble_vote_batch": "events",
    "numeric_consensus": "events",
    "label_consensus": "lineitem",
    "winsorize": "lineitem",
    "sanitize": "lineitem",
    "leaderboard": "events",
    "roc_auc": "labels",
    "ecdf": "events",
    "nearest_neighbors": "embeddings",
    "knn_classify": "embeddings",
    "smote": "embeddings",
    "score_batch": "part",
    "pack_replicates": "lineitem",
    "positional_join": "orders",
    "stratified_split": "embeddings",
    "dedup_keep_first": "events",
    "insert_if_absent": "orders",
    "clean_text": "documents",
    "fingerprint": "documents",
    "stream_score_insert": "events",
    "chunked_inference": "embeddings",
    "logistic_regression": "embeddings",
    "random_forest": "embeddings",
    "extra_trees": "embeddings",
    "boosted_trees": "embeddings",
    "support_vectors": "embeddings",
    "perceptron": "embeddings",
}
# Those that answer for the held-out part of the table.
OF_HELD_OUT = {
    "nearest_neighbors", "knn_classify", "logistic_regression", "random_forest", "extra_trees", "boosted_trees",
    "support_vectors", "perceptron",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    wanted = sys.argv[1:] or list(HEADLINE)
    rows = {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in {HEADLINE[q] for q in wanted}}

    # Start the JVM's code paths and the Python workers before the clock runs.
    for name in ("ensemble_vote_batch", "chunked_inference"):
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()

    times, rates = {}, {}
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        rates[name] = round(rows[HEADLINE[name]] * (HELD_OUT if name in OF_HELD_OUT else 1) / times[name], 1)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows_per_sec": rates,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
