"""Timed headline queries; prints one JSON line.

BENCH_SF_DIR selects the scale folder and BENCH_CPUS the number of cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from twinfold.plans import registry  # noqa: E402
from twinfold.session import build_session  # noqa: E402

HEADLINE = (
    "number_check",
    "coverage_rollup",
    "multiset_diff",
    "validate_eval_inputs",
    "score_arms",
    "budget_check",
    "reconcile",
    "grid_occupancy",
    "fragment_ownership",
    "overlapping_fragments",
    "group_rows",
    "read_units_html",
    "hourly_rate_limit",
    "compare_tables",
    "score_structure",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        started = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
