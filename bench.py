"""Headline queries, timed warm; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and cores.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fernmill.plans.queries import QUERIES  # noqa: E402
from fernmill.session import local_session  # noqa: E402

HEADLINE = [
    "group_rank", "serve_filter", "tag_offers", "value_label", "quality_score", "verified_offers", "duplicate_pairs", "greedy_merge", "consolidated_tiers", "candidate_windows", "context_window", "dedupe_normalized", "html_visible_lines",
    "html_links", "url_canonical", "carry_forward_stale", "archive_variants", "history_retention", "fair_queue", "quota_topk", "budget_greedy", "report_resolution", "source_catalogue", "haversine_radius", "open_status",
]


def main() -> None:
    data, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    taken: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):  # the second run counts: code is compiled then
            start = time.perf_counter()
            QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
            taken[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": Path(data).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
