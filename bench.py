"""Time the headline queries, each once after the session has warmed up. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "bm25_topk", "tfidf_word_topk", "dense_topk", "hybrid_rrf", "hybrid_rrf_rerank", "parent_collapse", "metrics_by_slice", "clean_text_rules", "repeated_lines",
    "pack_parents", "children_balanced", "concept_mastery", "latest_progress", "history_last_n",
)


def main() -> None:
    from marginalia.plans import catalogue
    from marginalia.session import session

    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    more = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    spark = session("bench", f"local[{cpus}]", **more)
    spark.sparkContext.setLogLevel("ERROR")
    known, took = catalogue.queries(), {}
    for name in (HEADLINE[0], *HEADLINE):
        began = time.time()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
