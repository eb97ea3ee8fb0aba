"""Hard-negative mining over an STR-packed R-tree of integer vectors.

Each anchor's positives are the rows of its label with the highest inner
products.  For each positive, the negatives are the best rows of other labels
whose score lies in a window of percentages of the positive's score.

Index: sort-tile-recursive packing cuts the space into tiles at quantiles of
one coordinate after the other (widest first; cuts fitted on at most
``SAMPLE`` rows, every row is indexed).  A tile of too many rows is dealt by a
hash of the row into trees of about ``TREE_ROWS``; each is packed down to
leaves of ``LEAF`` rows, ``FANOUT`` boxes to a parent, and stored with its boxes.

Search: a box bounds each coordinate, so it gives an interval for every
coordinate's product and, summed, for the inner product.  A best-first queue
opens the box with the highest possible score; a box goes unopened where no
anchor's window meets its interval, or where it lies strictly below all k-th
scores found so far (at the k-th score a smaller id may still win).  Scores in
a leaf are exact.

Anchors are a stated query set.  They come to all trees in blocks of at most
``BLOCK_ANCHORS``, the size of the broadcast.  Trees are searched in waves,
each about four times the last, and a wave starts from the k-th scores of the
ones before, so a task returns few rows that do not stay.

Edge cases: rows with a null label, a null vector, or a null or non-finite
component take no part; a null id is no anchor, comes after all ids and stays
null in the result; shorter vectors count as filled up with zeros; rows are
told apart by row, so rows of one id may differ, and a repeated anchor row is
two anchors; ties go by the smaller id; extra columns are not read; an empty
table gives no rows.  Scores are exact integers; a table whose scores may pass
64 bits is refused.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import stage, to_arrays

SAMPLE = 20_000
#: tiles that SAMPLE rows can tell apart
TILES = 1024
TREE_ROWS, LEAF, FANOUT = 4096, 64, 8
BLOCK_ANCHORS = 16_384
#: anchors that go through a tree together; neighbours, so that boxes fall for all of them
TOGETHER = 256
WAVE = 4
LAST, FAR = (1 << 63) - 1, 1 << 62


def _matrix(lists: pa.Array, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles, rows filled up with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy(
        zero_copy_only=False)
    return np.floor(out * scale)


# ---- packing

def _slabs(pages: int, dims: int) -> int:
    """Slabs of the first of ``dims`` coordinates for so many pages; at least two."""
    return max(2, int(np.ceil(round(pages ** (1 / max(dims, 1)), 9))))


def fit_tiles(sample: np.ndarray, dims: list[int], tiles: int):
    """Cuts of a sample into tiles: (coordinate, cut values, children), or None for one tile."""
    if tiles <= 1 or not dims or not len(sample):
        return None
    slabs = _slabs(tiles, len(dims))
    x = np.sort(sample[:, dims[0]])
    cuts = np.unique(x[[len(x) * i // slabs for i in range(1, slabs)]])
    slab = np.searchsorted(cuts, sample[:, dims[0]], side="right")
    return dims[0], cuts, [fit_tiles(sample[slab == i], dims[1:], -(-tiles // slabs)) for i in range(len(cuts) + 1)]


def tile_of(q: np.ndarray, cuts, first: int = 0) -> tuple[np.ndarray, int]:
    """Tile number of each row in packing order, and the number after the last."""
    if cuts is None:
        return np.full(len(q), first), first + 1
    dim, values, children = cuts
    slab, out = np.searchsorted(values, q[:, dim], side="right"), np.empty(len(q), dtype=np.int64)
    for i, child in enumerate(children):
        at = np.flatnonzero(slab == i)
        out[at], first = tile_of(q[at], child, first)
    return out, first


def pack(q: np.ndarray, dims: list[int], rows: np.ndarray) -> list[np.ndarray]:
    """Row numbers of each leaf, by sort-tile-recursion."""
    pages = -(-len(rows) // LEAF)
    if pages <= 1:
        return [rows]
    slabs = _slabs(pages, len(dims)) if dims else pages
    if dims:
        rows = rows[np.argsort(q[rows, dims[0]], kind="stable")]
    each = -(-pages // slabs) * LEAF
    return [leaf for i in range(0, len(rows), each) for leaf in pack(q, dims[1:], rows[i:i + each])]


def boxes(q: np.ndarray, cuts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(low, high) corners of all nodes, leaves first, FANOUT to a parent, up to one root."""
    levels = [(np.minimum.reduceat(q, cuts), np.maximum.reduceat(q, cuts))]
    while len(levels[-1][0]) > 1:
        at = np.arange(0, len(levels[-1][0]), FANOUT)
        levels.append((np.minimum.reduceat(levels[-1][0], at), np.maximum.reduceat(levels[-1][1], at)))
    return levels


TREE = "wave int, q array<{0}>, id array<long>, label array<long>, row array<long>, cuts array<int>, low array<{0}>, high array<{0}>"


def _packer(width: int, scale: float, dims: list[int], kind: pa.DataType) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        q = _matrix(table.column("vector"), width, scale)
        leaves = pack(q, dims, np.arange(len(q)))
        order, cuts = np.concatenate(leaves), np.cumsum([0, *map(len, leaves[:-1])])
        levels = boxes(q[order], cuts)
        one = lambda x, t: pa.array([x], pa.list_(t))
        flat = lambda side: one(np.concatenate([level[side].ravel() for level in levels]).astype(np.int64), kind)
        columns = {c: one(table.column(c).to_numpy()[order], pa.int64()) for c in ("id", "label", "row")}
        return pa.table({"wave": table.column("wave")[:1], "q": one(q[order].ravel().astype(np.int64), kind), **columns,
                         "cuts": one(cuts, pa.int32()), "low": flat(0), "high": flat(1)})
    return run


# ---- search

class Tree:
    """A stored tree: rows in leaf order and the boxes of each level, leaves first."""

    def __init__(self, batch: pa.RecordBatch, i: int, width: int, number: type):
        get = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)
        self.id, self.label, self.row = get("id"), get("label"), get("row")
        self.q = get("q").astype(number).reshape(-1, width)
        self.cuts = np.append(get("cuts"), len(self.id))
        low, high = (get(c).astype(number).reshape(-1, width) for c in ("low", "high"))
        self.levels, count, start = [], len(self.cuts) - 1, 0
        while True:
            self.levels.append((low[start:start + count], high[start:start + count]))
            if count == 1:
                break
            start, count = start + count, -(-count // FANOUT)


class Queries:
    """Anchors with their windows, and the best rows found for each.

    ``anchor`` holds the vectors, ``of`` each query's anchor, ``low`` and
    ``high`` its window; ``same`` says whether rows of the anchor's label count
    or those of other labels.
    """

    def __init__(self, anchor, row, label, of, low, high, k: int, same: bool):
        self.anchor, self.row, self.label, self.of = anchor, row, label, of
        self.plus, self.minus = np.maximum(anchor, 0), np.minimum(anchor, 0)
        self.low, self.high, self.k, self.same = low, high, k, same
        self.score = np.full((len(of), k), -FAR, dtype=np.int64)
        self.id = np.full((len(of), k), LAST, dtype=np.int64)

    def least(self, live: np.ndarray) -> np.ndarray:
        """The score a row must have to count."""
        return np.maximum(self.low[live], self.score[live, -1])

    def search(self, tree: Tree) -> None:
        turn, top = 0, len(tree.levels) - 1
        queue = [(0, 0, top, 0, *self._meeting(np.arange(len(self.of)), *tree.levels[top], 0))]
        while queue:
            _, _, level, node, live, up = heapq.heappop(queue)
            live = live[up >= self.least(live)]  # k-th scores have risen meanwhile
            if not len(live):
                continue
            if level == 0:
                self._leaf(tree, slice(tree.cuts[node], tree.cuts[node + 1]), live)
                continue
            low, high = tree.levels[level - 1]
            for child in range(node * FANOUT, min((node + 1) * FANOUT, len(low))):
                some, up = self._meeting(live, low, high, child)
                if len(some):
                    turn += 1
                    hope = int(np.minimum(up, self.high[some]).max())
                    heapq.heappush(queue, (-hope, turn, level - 1, child, some, up))

    def _meeting(self, live, low, high, node) -> tuple[np.ndarray, np.ndarray]:
        """The queries whose window meets the box's interval of scores, and its upper ends."""
        up = (self.plus @ high[node] + self.minus @ low[node])[self.of[live]]
        down = (self.plus @ low[node] + self.minus @ high[node])[self.of[live]]
        meets = (up >= self.least(live)) & (down <= self.high[live])
        return live[meets], up[meets]

    def _leaf(self, tree: Tree, rows: slice, live: np.ndarray) -> None:
        anchors, back = np.unique(self.of[live], return_inverse=True)
        fits = tree.label[rows][None, :] == self.label[anchors][:, None]
        fits = (fits if self.same else ~fits) & (tree.row[rows][None, :] != self.row[anchors][:, None])
        score = (self.anchor[anchors] @ tree.q[rows].T).astype(np.int64)
        score = np.where(fits, score, -FAR)[back]
        score[(score < self.least(live)[:, None]) | (score > self.high[live][:, None])] = -FAR
        some = np.flatnonzero((score > -FAR).any(axis=1))
        if not len(some):
            return
        live = live[some]
        scores = np.hstack([self.score[live], score[some]])
        ids = np.hstack([self.id[live], np.broadcast_to(tree.id[rows], (len(some), rows.stop - rows.start))])
        best = np.lexsort((ids, -scores), axis=1)[:, :self.k]
        self.score[live] = np.take_along_axis(scores, best, axis=1)
        self.id[live] = np.take_along_axis(ids, best, axis=1)


FOUND = "query long, score long, id long"


def _searcher(sent, width: int, number: type, k: int, same: bool) -> Callable:
    """All trees of a task, one group of neighbouring anchors after the other."""

    def run(batches):
        s = sent.value
        anchor = s["anchor"].astype(number)
        groups = []
        for i in range(0, len(anchor), TOGETHER):
            at = np.flatnonzero((s["of"] >= i) & (s["of"] < i + TOGETHER))
            part = slice(i, i + TOGETHER)
            groups.append((at, Queries(anchor[part], s["row"][part], s["label"][part], s["of"][at] - i,
                                       s["low"][at], s["high"][at], k, same)))
        for b in batches:
            for i in range(len(b)):
                tree = Tree(b, i, width, number)
                for _, queries in groups:
                    queries.search(tree)
        for at, queries in groups:
            found = queries.score > -FAR
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(at, found.sum(axis=1))), pa.array(queries.score[found]), pa.array(queries.id[found])],
                names=["query", "score", "id"])
    return run


def _best(trees: DataFrame, waves: int, queries: dict[str, np.ndarray], width: int, number: type, k: int,
          same: bool) -> DataFrame:
    """The best k rows of each query: query, rank, score, id."""
    spark, found = trees.sparkSession, None
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    for wave in range(waves):
        sent = spark.sparkContext.broadcast(queries)
        new = trees.filter(F.col("wave") == wave).mapInArrow(_searcher(sent, width, number, k, same), FOUND)
        every = new if found is None else new.unionByName(found.select("query", "score", "id"))
        found = stage(every.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k))
        sent.unpersist()
        kth = to_arrays(found.filter(F.col("rank") == k).select("query", "score"))  # a row per query at most
        queries = {**queries, "low": queries["low"].copy()}
        queries["low"][kth["query"]] = kth["score"]
    return found


def mine(df: DataFrame, anchors: Column, id_col: str = "vec_id", label: str = "label", vector: str = "embedding",
         scale: float = 256.0, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Rows anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x).  A negative's score is ``low`` to
    ``high`` percent of the positive's.  ``anchors`` says which rows are anchors.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = (df.filter(F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
              .select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("id"), F.col(label).cast("bigint").alias("label"),
                      F.col(vector).alias("vector"), F.coalesce(anchors & F.col(id_col).isNotNull(), F.lit(False)).alias("is_anchor")))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()))
    most = F.array_max(F.transform("vector", lambda x: F.abs(F.floor(x.cast("double") * scale).cast("double"))))
    n, n_anchors, width, largest = rows.agg(F.count(F.lit(1)), F.count_if("is_anchor"), F.max(F.size("vector")), F.max(most)).first()
    empty = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not n_anchors:
        return df.sparkSession.createDataFrame([], empty)
    width, reach = max(width, 1), max(width, 1) * (largest or 0.0) ** 2
    if reach >= FAR:
        raise ValueError("inner products may pass 64 bits")
    number, kind = (np.float64 if reach < 1 << 53 else np.int64), ("int" if (largest or 0) < 1 << 31 else "long")

    # tiles, fitted on a bounded sample; trees of a tile by a hash of the row
    share = F.pmod(F.xxhash64("row", F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = _matrix(rows.filter(share < min(1.0, SAMPLE / n)).select("vector").toArrow().column("vector"), width, scale)
    spread = sample.var(axis=0) if len(sample) else np.zeros(width)
    dims = [int(i) for i in np.argsort(-spread, kind="stable")]
    cuts = fit_tiles(sample, dims, min(TILES, -(-n // TREE_ROWS)))

    def place(batches):
        for b in batches:
            tile, _ = tile_of(_matrix(b.column("vector"), width, scale), cuts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tile, pa.int32())], names=[*b.schema.names, "tile"])

    schema = StructType([*rows.schema.fields, StructField("tile", IntegerType())])
    placed = rows.mapInArrow(place, schema)
    sizes = placed.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(TREE_ROWS))).cast("int").alias("trees"))
    n_trees = sizes.agg(F.sum("trees")).first()[0]
    waves = 1
    while 2 * WAVE ** waves < n_trees:
        waves += 1
    # the last wave holds most trees, each one before it a quarter of the next
    draw = F.pmod(F.xxhash64("tile", "tree", F.lit("wave")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    wave = sum((F.when(draw < float(WAVE) ** -i, 1).otherwise(0) for i in range(1, waves)), F.lit(0))
    dealt = (placed.join(F.broadcast(sizes), "tile")  # TILES rows at most, or one per value of the cuts
                   .withColumn("tree", F.pmod(F.xxhash64("row"), F.col("trees")).cast("int"))
                   .withColumn("wave", (F.lit(waves - 1) - wave).cast("int")))
    packer = _packer(width, scale, dims, pa.int32() if kind == "int" else pa.int64())
    trees = stage(dealt.select("tile", "tree", "wave", "id", "label", "row", "vector").groupBy("tile", "tree")
                       .applyInArrow(packer, TREE.format(kind)))

    blocks, results = -(-n_anchors // BLOCK_ANCHORS), []
    for block in range(blocks):
        mine_ = rows.filter("is_anchor").filter(F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks)) == block)
        table = mine_.select("id", "label", "row", "vector").toArrow()  # about BLOCK_ANCHORS rows
        q = _matrix(table.column("vector"), width, scale)
        order = np.lexsort((table.column("row").to_numpy(), tile_of(q, cuts)[0]))
        ids, about = table.column("id").to_numpy()[order], {
            "anchor": q[order].astype(np.int64), "row": table.column("row").to_numpy()[order],
            "label": table.column("label").to_numpy()[order]}
        m = len(ids)
        if not m:
            continue
        best = _best(trees, waves, {**about, "of": np.arange(m), "low": np.full(m, -FAR + 1), "high": np.full(m, FAR)},
                     width, number, positives, True)
        best = to_arrays(best.select("query", "rank", "score", "id"))  # ``positives`` rows per anchor at most
        p = best["score"].astype(np.int64)
        pairs = {**about, "of": best["query"], "low": -(-low * p // 100), "high": high * p // 100}
        found = _best(trees, waves, pairs, width, number, negatives, False)
        names = pa.table({"query": pa.array(np.arange(len(p))), "anchor_id": ids[best["query"]], "positive_id": best["id"],
                          "positive_score": p})
        named = found.join(F.broadcast(df.sparkSession.createDataFrame(names)), "query")  # as many rows
        known = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c if c != "id" else "negative_id")
        results.append(named.select("anchor_id", known("positive_id"), "rank", known("id"), "positive_score",
                                    F.col("score").alias("negative_score")))
    return reduce(DataFrame.unionByName, results)
