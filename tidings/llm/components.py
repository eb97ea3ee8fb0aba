"""Connected components of a link table by alternating stars.

Each round hooks every node's larger neighbours, then its smaller ones, onto
the smallest node around it (large-star and small-star of Kiveris et al.,
2014), until no link changes.  A node's links are only ever grouped by
minimum and joined back, never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _least_around(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is its least node."""
    down = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = down.unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (both.join(_least_around(both), "a").filter("b > a")
                     .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        near = _least_around(large)
        small = (large.join(near, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                      .unionByName(near.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        down = stage(small)
        now = down.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return down.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        down.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
