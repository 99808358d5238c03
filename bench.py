"""Time the headline queries; prints one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) on local[BENCH_CPUS]. Every query is
run to completion over all its rows (the noop sink keeps results out of the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kbspark.plans import registry  # noqa: E402
from kbspark.session import build_session  # noqa: E402

HEADLINE = (
    "knn_l2", "bm25", "fts_match", "gram_index", "embed", "rrf_hybrid", "retrieve_chunks", "keyword_snippet", "notes_prefilter",
    "chunk", "sentence_split", "page_articles", "content_ids", "near_dedup", "route_ingest", "repeat_limit", "rss_episodes",
    "usage_breakdown", "session_list", "rate_limit_by_user", "queue_position", "job_fold", "library", "transcript_document",
    "cascade_delete", "upsert", "apply_changes", "audit", "passages", "recall_mrr", "attribution",
)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = build_session(cpus=os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.all_queries()
    times: dict[str, float] = {}
    queries["usage_breakdown"](spark, root).write.format("noop").mode("overwrite").save()  # start-up is not measured
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(root).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
