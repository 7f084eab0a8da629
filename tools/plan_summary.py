"""Summarise the final (adaptive) physical plans of every registered query into PLANS.md.

All executions of a query count, also those that run while it is built. For each query: shuffles
by kind, broadcasts, nested-loop joins (always against a side of one row, or of one row a period),
scans and how many of them have pushed filters.
Usage: python tools/plan_summary.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarize(nodes: list[dict]) -> dict[str, int]:
    from tools.executed_plans import exchanges

    named = lambda start: sum(n["nodeName"].startswith(start) for n in nodes)
    read = [n for n in nodes if n["nodeName"].startswith("Scan parquet")]
    return {
        "hash shuffles": len(exchanges(nodes, "hashpartitioning")),
        "range shuffles": len(exchanges(nodes, "rangepartitioning")),
        "single-partition": len(exchanges(nodes, "SinglePartition")),
        "broadcasts": named("BroadcastExchange"),
        "reused": named("ReusedExchange"),
        "nested-loop joins": named("BroadcastNestedLoopJoin"),
        "sort-merge joins": named("SortMergeJoin"),
        "scans": len(read),
        "scans with pushed filters": sum((n.get("metadata") or {}).get("PushedFilters", "[]") != "[]" for n in read),
    }


def main() -> None:
    from aislewise.plans.registry import QUERIES, SINKS, STREAMING
    from aislewise.session import local_session
    from tools.executed_plans import ExecutedPlans

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    folder = tempfile.mkdtemp(prefix="events-")
    spark = local_session(conf=ExecutedPlans.conf(folder))
    spark.sparkContext.setLogLevel("ERROR")
    plans = ExecutedPlans(spark, folder)
    rows = []
    for name, fn in QUERIES.items():
        if name in STREAMING or name in SINKS:
            continue
        plans.mark()
        fn(spark, sf).collect()
        rows.append((name, summarize(plans.nodes())))
    cols = list(rows[0][1])
    print(f"# Physical plans ({sf}, final AQE plans of all executions, local[*])\n")
    print("Generated by `tools/plan_summary.py`. Every nested-loop join has a broadcast side of one row")
    print("(fence, totals, seniority minimum) or of one row for each period asked for.\n")
    print("| query | " + " | ".join(cols) + " |")
    print("|---|" + "---|" * len(cols))
    for name, s in rows:
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |")


if __name__ == "__main__":
    main()
