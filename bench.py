"""Time the headline queries and print one JSON line."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from binomia.session import local_session  # noqa: E402
from binomia.workloads.queries import QUERIES  # noqa: E402

HEADLINE = [
    "tokenize_names",
    "subspecies_anchors",
    "best_match",
    "match_candidates",
    "match_documents",
    "matched_rows",
    "most_specific_order",
    "taxonomy_keys",
    "record_pools",
    "rescue_names",
    "report_items",
    "heat_grid",
]


def run(spark, name, folder):
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        run(spark, name, folder)  # warm-up
        times[name] = round(statistics.median(run(spark, name, folder) for _ in range(repeats)), 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
