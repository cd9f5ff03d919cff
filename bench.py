"""Time the headline queries: one JSON line with seconds per query.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of local threads; query names as arguments narrow it.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from studysift.plans.catalogue import all_queries

HEADLINES = """
bib_fields required_fields dedupe_first duplicate_titles set_overlap surplus_titles year_profile
tokenize normalised_text lemmatize term_frequency document_frequency ngrams idf tfidf
score_affinity score_chi2 score_anova score_pearson select_k_best
seeded_shuffle quota_split year_order year_folds time_series_folds stratified_folds
threshold_sweep pr_curve binary_metrics reviewer_join agreement_distance knn_vote screening_rf
""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus) if cpus.isdigit() else 16))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.read.parquet(f"{folder}/documents.parquet").selectExpr("max(length(text))").collect()
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINES:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall-clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
