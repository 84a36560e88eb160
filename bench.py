"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder and ``BENCH_CPUS`` the local cores. Each query runs once
to warm up and then ``BENCH_RUNS`` times; the median counts. All rows are computed and discarded.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from epitrove.session import local_session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "position_frequencies",
    "build_position_table",
    "window_tallies",
    "upload_window_tallies",
    "top_candidates_by_window",
    "frequency_summary",
    "annotate_predictions",
    "facet_conservation",
    "generate_peptides",
    "min_percentile_by_position",
    "merge_predictions",
    "find_occurrences",
    "align_peptides",
    "align_references",
]


def seconds(spark, name: str, folder: str) -> float:
    began = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session()
    timed = {}
    for name in names:
        seconds(spark, name, folder)
        timed[name] = round(statistics.median(seconds(spark, name, folder) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timed.values()), 3), "unit": "sec",
        "queries": timed, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
