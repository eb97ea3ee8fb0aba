"""Per-query physical plan summary (for the scale review in PLANS.md).

    python scripts/plan_report.py [sf_dir]

Counts in the executed (pre-AQE) plan: shuffle exchanges, broadcast
exchanges, join strategies, aggregates, windows, generators, scans.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidings.plans.registry import QUERIES  # noqa: E402
from tidings.session import build_session  # noqa: E402

NODES = [("shuffles", r"Exchange hashpartitioning|Exchange RoundRobin|Exchange rangepartitioning|Exchange SinglePartition"),
         ("broadcasts", r"BroadcastExchange"),
         ("smj", r"SortMergeJoin"), ("bhj", r"BroadcastHashJoin"), ("shj", r"ShuffledHashJoin"),
         ("aggs", r"HashAggregate\(keys|ObjectHashAggregate\(keys|SortAggregate\(keys"),
         ("windows", r"Window \["), ("group_limits", r"WindowGroupLimit"),
         ("generates", r"Generate "), ("scans", r"FileScan|Scan ExistingRDD|Scan parquet"),
         ("python", r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas")]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    # broadcasts off: the plan that large tables would get
    spark = build_session("local[8]", shuffle_partitions=8, extra={"spark.sql.autoBroadcastJoinThreshold": "-1"})
    print("| key | " + " | ".join(n for n, _ in NODES) + " |")
    print("| --- |" + " --- |" * len(NODES))
    for k, fn in QUERIES.items():
        if k in ("outbox_sink", "webhook_stream"):
            continue
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        counts = [len(re.findall(p, plan)) for _, p in NODES]
        print(f"| `{k}` | " + " | ".join(str(c) for c in counts) + " |")


if __name__ == "__main__":
    main()
