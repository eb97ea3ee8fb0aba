"""Benchmark: run the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [key ...]

Each query runs to completion through the ``noop`` sink (every row and
column computed, nothing collected to the driver).  Before timing, every
query runs once untimed on the small ``BENCH_WARMUP_DIR`` tables (default:
the sibling sf0.01 folder) so JIT and codegen caches are warm — the plan
shapes are identical at every scale.  Seconds are wall time of one run per
query at ``BENCH_SF_DIR``; ``value`` is their sum, and ``ratio`` compares each
with a timed run on the warm-up tables.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidings.plans.registry import QUERIES  # noqa: E402
from tidings.session import build_session  # noqa: E402

#: every library key; the training-data queries have the check tool
HEADLINE = list(QUERIES)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    keys = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", "tidings-bench", shuffle_partitions=2 * cpus)
    warm = os.environ.get("BENCH_WARMUP_DIR",
                          os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01"))
    if not os.path.isdir(warm):
        warm = sf_dir
    for k in keys:  # untimed warm-up pass on small tables
        QUERIES[k](spark, warm).write.format("noop").mode("overwrite").save()
    small = {}
    for k in keys:
        t = time.time()
        QUERIES[k](spark, warm).write.format("noop").mode("overwrite").save()
        small[k] = time.time() - t
    times = {}
    for k in keys:
        t = time.time()
        QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.time() - t, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "ratio": {k: round(times[k] / small[k], 2) for k in keys},
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
