"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import importlib.util
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "entity_overview", "canonical_type_vote", "entity_nodes", "rel_edges", "neighborhood_top15", "context_sections", "cross_doc_entities", "sentence_pack",
    "chunk_unit", "article_split", "recital_split", "subparagraph_split", "footnote_strip", "stratified_sample", "verdict_overlay", "precision_by_type",
    "extract_rules", "answers", "p3_found", "p4_found", "p1_found", "p2_found", "p5_found", "p6_found", "p7_found", "p8_found", "p9_found", "p10_found",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from kgspark.session import build_session

    spark = build_session(f"local[{cpus}]", "bench", {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spec = importlib.util.spec_from_file_location("entry", os.path.join(os.path.dirname(os.path.abspath(__file__)), "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    registry, took = entry.queries(), {}
    spark.read.parquet(f"{sf_dir}/registry.parquet").count()
    for name in HEADLINE:
        if name not in registry:
            continue
        best = None
        for _ in range(2):
            t = time.perf_counter()
            registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - t)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "total_best_of_two", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
