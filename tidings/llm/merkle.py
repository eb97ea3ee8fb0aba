"""Merkle manifest of a table: a hash tree per group of rows, and one over the groups.

Every row is a leaf.  The leaves of a group stand in order; runs of ``fanout``
consecutive nodes become their hash, level by level, until one node remains,
the group's subroot.  The subroots in order make the root in the same way.

A level is one self-join.  Each node computes the places of its siblings (its
slot shifted by 1 to fanout - 1 inside its run; for a fanout of two that is
the exclusive or with 1) and sends its digest there; nodes and sent digests meet
by an equijoin on the place.  So every node learns its siblings, which are its
step of the proof, and the rows of slot zero emit the parents.  Proofs come
back down by joins of a run with its parent.

Places come from a range partitioning: rows are numbered inside their range and
shifted by the counts of the ranges before, so no task holds a group.  Equal
rows differ by a row number for the ranges, so copies spread too.

``H`` is lower-case hex SHA-256 of the UTF-8 text of its inputs one after the
other, digests as hex.  A leaf is H of its fields, each ``-`` for null, else
the number of UTF-8 bytes, ``:`` and the value (numbers as decimal text).

Edge cases: a null group is a group of its own and comes first, a null in the
order comes first; ties in the order go by the leaf's digest, rows equal in
both are interchangeable; empty and very long texts are fields like others;
extra columns are not read, carried columns may have any name; an empty table
has no leaves, no root and gives no rows; a lone leaf is its subroot, a lone
subroot the root, with empty proofs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

FANOUT = 8
#: groups whose subroot and proof may be broadcast (about 10 MB); beyond, they shuffle
BROADCAST_GROUPS = 10_000


def digest_of(binary: Column) -> Column:
    """H of concatenated digests, from and to binary."""
    return F.unhex(F.sha2(F.lower(F.hex(binary)).cast("binary"), 256))


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_digest(*fields: Column) -> Column:
    """Binary digest of a row's fields."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(path, digest, lambda d, step: digest_of(F.concat(step["left"], d, step["right"])))


def proof_digest(path: Column) -> Column:
    """H of all siblings of a proof, level by level, left to right; hex."""
    siblings = F.transform(path, lambda step: as_hex(F.concat(step["left"], step["right"])))
    return F.sha2(F.array_join(siblings, "").cast("binary"), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (tree, ...) with their place in the tree by ``order``, from 0, and the tree's size n."""
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    dealt = stage(rows.repartitionByRange("tree", *order, "row").withColumn("part", F.spark_partition_id()))
    parts = Window.partitionBy("tree").orderBy("part")  # one row per tree and range
    shifts = (dealt.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("k"))
                   .select("tree", "part", (F.sum("k").over(parts) - F.col("k")).alias("shift"),
                           F.sum("k").over(Window.partitionBy("tree")).alias("n")))
    inside = Window.partitionBy("tree", "part").orderBy(*order, "row")
    return (dealt.withColumn("place", F.row_number().over(inside) - 1).join(shifts, ["tree", "part"])
                 .withColumn("place", F.col("place") + F.col("shift")).drop("row", "part", "shift"))


def _with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes (tree, place, n, digest) with the digests left and right of them in their run."""
    slot = F.col("place") % fanout
    sent = (nodes.withColumn("shift", F.explode(F.sequence(F.lit(1), F.lit(fanout - 1))))
                 .select("tree", (F.col("place") - slot + (slot + F.col("shift")) % fanout).alias("to"), "n",
                         F.struct("place", "digest").alias("sibling"))
                 .filter("to < n").select("tree", F.col("to").alias("place"), "sibling"))
    met = (nodes.join(sent, ["tree", "place"], "left").groupBy("tree", "place", "n", "digest")
                .agg(F.sort_array(F.collect_list("sibling")).alias("siblings")))  # fanout - 1 at most

    def side(keep) -> Column:
        return F.aggregate(F.filter("siblings", keep), F.lit(b""), lambda all, s: F.concat(all, s["digest"]))
    return met.select("tree", "place", "n", "digest", side(lambda s: s["place"] < F.col("place")).alias("left"),
                      side(lambda s: s["place"] > F.col("place")).alias("right"))


def _climb(nodes: DataFrame, height: int, fanout: int) -> tuple[DataFrame, DataFrame]:
    """(roots, paths) of trees of at most ``height`` levels: tree and root; tree, place of a leaf and its proof."""
    levels, roots = [], [nodes.filter("n = 1").select("tree", F.col("digest").alias("root"))]
    for _ in range(height):
        level = stage(_with_siblings(nodes.filter("n > 1"), fanout))
        levels.append(level)
        nodes = (level.filter(F.col("place") % fanout == 0)
                      .select("tree", F.floor(F.col("place") / fanout).alias("place"),
                              F.ceil(F.col("n") / fanout).alias("n"),
                              digest_of(F.concat("left", "digest", "right")).alias("digest")))
        roots.append(nodes.filter("n = 1").select("tree", F.col("digest").alias("root")))
    paths = None
    for level in reversed(levels):
        step = F.array(F.struct("left", "right"))
        if paths is None:
            paths = level.select("tree", "place", step.alias("path"))
        else:
            above = paths.select("tree", F.col("place").alias("run"), F.col("path").alias("above"))
            paths = (level.withColumn("run", F.floor(F.col("place") / fanout)).join(above, ["tree", "run"], "left")
                          .select("tree", "place", F.concat(step, F.coalesce("above", F.array())).alias("path")))
    return reduce(DataFrame.unionByName, roots), paths


def _height(numbers: DataFrame, fanout: int) -> int:
    """Levels above the leaves of the largest tree."""
    n, height = numbers.agg(F.max("n")).first()[0] or 1, 0
    while n > 1:
        n, height = -(-n // fanout), height + 1
    return height


def manifest(df: DataFrame, fields: list[str], group: str, order: str, carried: list[Column] | None = None,
             fanout: int = FANOUT) -> DataFrame:
    """One row per input row: leaf, subroot, root (binary), path and ``carried``, a struct of the carried columns.

    ``path`` is the proof, an array of (left, right): the digests before and
    after the node in its run, from the leaf up to the root.
    """
    name = F.col(group).cast("string")
    empty = F.array().cast("array<struct<left:binary,right:binary>>")
    leaves = stage(df.select(
        F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("tree"),  # null first, the rest in byte order
        F.col(order).alias("key"), leaf_digest(*[F.col(f) for f in fields]).alias("digest"),
        F.struct(*(carried or [F.col(order)])).alias("carried")))
    placed = stage(numbered(leaves, ["key", "digest"]))
    subroots, paths = _climb(placed.drop("key", "carried"), _height(placed, fanout), fanout)

    subroots = stage(subroots)
    upper = stage(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"),
                                           F.col("root").alias("digest")), ["group"]))
    roots, above = _climb(upper.drop("group"), _height(upper, fanout), fanout)
    groups = upper.join(roots, "tree").select("tree", "place", F.col("group"), F.col("digest").alias("subroot"), "root")
    if above is not None:
        groups = groups.join(above.withColumnRenamed("path", "above"), ["tree", "place"])
    else:
        groups = groups.withColumn("above", empty)
    groups = stage(groups.select(F.col("group").alias("tree"), "subroot", "root", "above"))
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)

    rows = placed.select("tree", "place", F.col("digest").alias("leaf"), "carried")
    rows = rows.join(paths, ["tree", "place"], "left") if paths is not None else rows.withColumn("path", empty)
    return rows.join(groups, "tree").select(
        "leaf", "subroot", "root", F.concat(F.coalesce("path", empty), "above").alias("path"), "carried")
