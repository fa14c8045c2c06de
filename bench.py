"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the cores. Every query is run once to warm up and
then timed; its rows are fully computed and dropped.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pagestrata.plans.catalogue import load  # noqa: E402
from pagestrata.session import build_session  # noqa: E402

HEADLINE = [
    "url_canonicalize", "page_type", "host_taxonomy", "link_extract", "link_targets", "edge_target_join", "link_depth",
    "prominence", "frontier_topk", "robots_filter", "html_sections", "clean_text", "content_digest_dedup",
    "section_truncate", "markdown_chunks", "budget_selection", "batch_packing", "evidence_summary",
    "snapshot_reconcile", "source_disagreement", "cdx_records", "wayback_records", "priority_score",
    "priority_rollup", "approval_gate", "evaluation_routing",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = load(), {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(folder).name}))
    spark.stop()


if __name__ == "__main__":
    main()
