"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed to completion through the ``noop`` sink (every row is
produced, nothing is collected to the driver): one warm-up run, then
$BENCH_RUNS timed runs; the per-query figure is the median.  Prints one JSON
line; the headline value is the sum of the medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerflow.plans.catalog import QUERIES  # noqa: E402
from ledgerflow.session import build_session  # noqa: E402

HEADLINE = [
    "accountant_leaderboard",   # aggregate + two joins + sort (the flagship)
    "dashboard_overview",       # 13 figures, one scan per table
    "return_stats_by_accountant",
    "monthly_revenue",
    "filing_performance",
    "return_summary",           # four-way join chain
    "page_returns",             # joined listing, top-k page
    "return_detail",            # four child aggregates joined back
    "activity_feed",
    "set_status",               # change batch applied to the whole table
    "create_returns_dedup",
    "cascade_users",            # cascading delete with blocking references
    "visible_returns",          # entitlement joins
    "dq_unique",
    "dq_foreign_key",
    "validate_inquiries",       # whole message texts
    "request_rate_breaches",    # windowed count (streaming plan on batch input)
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    conf = {"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")}
    spark = build_session(f"local[{cpus}]", app="ledgerflow-bench",
                          shuffle_partitions=max(cpus * 2, 8), extra=conf)
    times: dict[str, float] = {}
    for name in names:
        fn = QUERIES[name]
        samples = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "sum of median query seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "runs": runs,
        "settings": {"shuffle_partitions": max(cpus * 2, 8), "aqe": True},
    }))


if __name__ == "__main__":
    main()
