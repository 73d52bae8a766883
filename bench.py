"""Times the headline queries once each, after two of them have warmed the session up, and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from fleetledger.catalog import QUERIES
from fleetledger.session import local_session

HEADLINE = (
    "j1_replay_scores",
    "a1_replay_report",
    "s12_net_changes",
    "a2_log_stats",
    "a5_staleness",
    "a11_budget_breakdown",
    "w5_greedy_trim",
    "w1_fence_state",
    "w2_sections",
    "w14_chunk_ordinal",
    "j12_duplicate_blocks",
    "j11_dead_references",
    "w15_soft_language",
    "sec1_secret_findings",
    "j9_refresh_plan",
    "a16_hash_fidelity",
    "j13_referenced_files",
    "j18_importer_evidence",
    "j19_declaration_choice",
    "w6_focused_units",
    "j29_merged_task_status",
    "j41_marker_occurrences",
    "a30_arm_effects",
)

#: Run first and not timed: one of windows and joins, one of text functions.
WARM_UP = ("a1_replay_report", "w1_fence_state")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    for name in WARM_UP:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
