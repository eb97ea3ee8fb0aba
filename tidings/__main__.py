"""Run one registered query or job and write its rows.

    spark-submit -m tidings job_story_broadcast /data/landed /data/out/outbox
    python -m tidings feed_status /root/testdata/sf0.01            # prints a sample

The input folder holds the landed tables as ``<name>.parquet``.  With an
output path the result is written as parquet (overwrite); otherwise a
sample is shown.
"""

from __future__ import annotations

import sys

from tidings.plans.registry import QUERIES
from tidings.session import build_session


def main(argv: list[str]) -> int:
    if len(argv) < 2 or argv[0] not in QUERIES:
        print(__doc__)
        print("keys:", " ".join(sorted(QUERIES)))
        return 2
    key, sf_dir = argv[0], argv[1]
    spark = build_session(app_name=f"tidings-{key}")
    df = QUERIES[key](spark, sf_dir)
    if len(argv) > 2:
        df.write.mode("overwrite").parquet(argv[2])
    else:
        df.show(20, truncate=120)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
