"""Summarise the physical plan of every query (development aid -> PLANS.md).

Plans are taken as Catalyst produces them before execution, with our session
defaults (no broadcast from size estimates), i.e. the shape the job keeps at
any scale; AQE may still coalesce partitions or convert a join to broadcast
once a stage's real size is known.  Explicit broadcasts seen here passed a
row-count check.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerflow.plans.catalog import QUERIES  # noqa: E402
from ledgerflow.session import build_session  # noqa: E402


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def summary(text: str) -> dict:
    lines = text.splitlines()

    def count(pat):
        return sum(1 for ln in lines if re.search(pat, ln))
    return {
        "shuffles": count(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)"),
        "broadcasts": count(r"BroadcastExchange"),
        "smj": count(r"SortMergeJoin"),
        "bhj": count(r"BroadcastHashJoin"),
        "partial_aggs": count(r"functions=\[partial_"),
        "group_limit": count(r"WindowGroupLimit .*Partial"),
        "scans": count(r"FileScan parquet|Scan ExistingRDD"),
        "pushed": count(r"PushedFilters: \[[^\]]"),
        "topk": count(r"TakeOrderedAndProject"),
    }


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    # as shuffles: what the planner broadcasts for its small files is left out
    spark = build_session("local[8]", shuffle_partitions=16,
                          extra={"spark.sql.autoBroadcastJoinThreshold": "-1"})
    rows = []
    for name in sorted(QUERIES):
        s = summary(plan_text(QUERIES[name](spark, sf_dir)))
        rows.append((name, s))
    cols = list(rows[0][1])
    print("| query | " + " | ".join(cols) + " |")
    print("| --- | " + " | ".join("---" for _ in cols) + " |")
    for name, s in rows:
        print(f"| `{name}` | " + " | ".join(str(s[c]) for c in cols) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
