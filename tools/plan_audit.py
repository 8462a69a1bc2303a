"""Scan every inspection query's physical plan for patterns that do not scale; exit 1 on a hit.

Flagged: cartesian and nested-loop joins, Python evaluation, sort-based
aggregation, unbounded rows dealt to one partition,
and a base table scanned more than ``MOST_SCANS`` times.
Usage: python tools/plan_audit.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lotlens.session import local_session  # noqa: E402
from lotlens.testing.registry import operators  # noqa: E402

PATTERNS = {
    "cartesian": r"CartesianProduct",
    "nested_loop": r"BroadcastNestedLoopJoin",
    "python": r"(BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas|MapInArrow)",
}
#: Counted before AQE reuses exchanges; grains in memory are planned from the detail each time.
MOST_SCANS = 20
#: One partition may get the partial results of a global aggregate, and a row per calendar day.
ONE_TASK_ALLOWED = re.compile(r"functions=\[partial_|functions=\[merge_|keys=\[\]|_day|_lots")


def findings(plan: str) -> dict[str, int]:
    lines = plan.splitlines()
    hits = {k: len(re.findall(p, plan)) for k, p in PATTERNS.items()}
    hits["one_task"] = sum("Exchange SinglePartition" in a and not ONE_TASK_ALLOWED.search(b)
                           for a, b in zip(lines, lines[1:]))
    hits["sort_aggregate"] = sum("SortAggregate" in x for x in lines)
    scans = plan.count("FileScan parquet")
    hits["scans"] = scans if scans > MOST_SCANS else 0
    return {k: v for k, v in hits.items() if v}


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = local_session()
    spark.conf.set("spark.sql.maxToStringFields", "1000")
    failed = 0
    for key, fn in operators().items():
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        hits = findings(plan)
        failed += bool(hits)
        exchanges = len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning", plan))
        print(f"{key:28s} scans={plan.count('FileScan parquet'):2d} shuffles={exchanges:2d} "
              f"broadcasts={plan.count('BroadcastExchange'):2d} {hits if hits else ''}")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
