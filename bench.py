"""Headline queries over BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "bm25_topk", "knn_cosine", "hybrid_fusion", "rrf_fusion", "graph_expand", "chunk_cover_asof", "coverage_first", "clamp_dispositions", "evict_prefix", "topic_terms",
    "topic_overlap", "content_hash_dups", "stub_ingest", "chunk_tiling", "loop_detect", "history_partition", "extractive_summary", "truncate_budget", "probe_rate",
    "thrash_analysis", "paired_delta", "confusion_f05", "rank_report", "majority_vote", "first_gold_rank",
)


def main() -> None:
    from quillspan.catalog import QUERIES
    from quillspan.session import local_session

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    QUERIES["content_hash_dups"](spark, folder).count()  # starts the JVM's code paths
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    sys.exit(main())
