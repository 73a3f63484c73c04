"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tarnlight.queries import QUERIES

HEADLINE = (
    "phrase_postings", "phrase_prefix_lookup", "phrase_evidence_topk", "shelf_jaccard", "relaxed_filters", "bm25_weighted_topk", "dense_topk", "rrf_fusion",
    "rerank_blend", "attribute_entropy", "best_question", "slot_decay", "technical_score", "terms_tokens", "classify_phrase", "customer_reply",
)
#: Timed besides; not part of the headline sum.
MORE = ("bm25_restricted_topk", "bm25_stemmed_topk", "evidence_primary_topk", "mmr_diversify", "dialog_fold", "parse_turns")


def main() -> None:
    data = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["technical_score"](spark, data).collect()  # starts the executors and compiles the common paths
    took = {}
    for name in HEADLINE + MORE:
        began = time.perf_counter()
        QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took[k] for k in HEADLINE), 3), "unit": "sec", "queries": took, "sf": os.path.basename(data.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
