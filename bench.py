"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   input folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated subset
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from ledgerleaf.plans import queries as q

HEADLINES = [
    "normalize_text", "labelled_counts", "char_ngrams", "tfidf_transform", "fit_nb", "score_nb",
    "fit_full", "score_full_plain", "score_full_explained", "classification_report", "dq_summary", "dq_duplicates", "train_test_split",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    wanted = os.environ.get("BENCH_QUERIES")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(max(8, 2 * int(cpus))))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = q.lines(spark, sf_dir).count()       # derive and store the statement lines once
    steps = {"fit_nb": lambda: q.nb_model(spark, sf_dir), "fit_full": lambda: q.full_model(spark, sf_dir),
             "score_full_explained": lambda: run(q.full_model(spark, sf_dir).transform(q.lines(spark, sf_dir), explain=True)),
             "score_full_plain": lambda: run(q.full_model(spark, sf_dir).transform(q.lines(spark, sf_dir)))}
    times = {}
    for name in wanted.split(",") if wanted else HEADLINES:
        start = time.perf_counter()
        if name in steps:
            steps[name]()
        else:
            run(q.QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
    out = {"metric": "total_wall", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": os.path.basename(sf_dir), "cores": int(cpus), "statement_lines": rows}
    for name in ("score_nb", "score_full_explained", "score_full_plain"):
        if name in times:
            out[f"{name}_lines_per_sec"] = round(rows / times[name], 1)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
