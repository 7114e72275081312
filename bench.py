"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.  Each query is planned
and run to the end (all columns computed, nothing kept) after one warm-up run; the best
of ``BENCH_RUNS`` counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from debtscope.queries import QUERIES  # noqa: E402
from debtscope.session import local_session  # noqa: E402

HEADLINE = [
    "repo_report",
    "repo_debt",
    "snapshot_resolve",
    "listing_join_content",
    "structure_summary",
    "hotspots",
    "grounded_answer",
    "bundle_rows",
    "recent_repos",
    "url_validate",
    "debt_score",
    "classify_errors",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session("bench", cores=cores, partitions=int(cores) if cores.isdigit() else 8)
    times = {}
    for name in HEADLINE:
        run(spark, name, sf_dir)
        times[name] = round(min(run(spark, name, sf_dir) for _ in range(runs)), 3)
    line = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
