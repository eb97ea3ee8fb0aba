"""Hard-negative mining against all inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidings.llm import negatives

RNG = np.random.default_rng(11)
SCHEMA = "vec_id long, label int, embedding array<float>, row int, tile string, wave int"


def table(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 0, "t", 1) for r in rows], SCHEMA).repartition(parts)


def expected(rows, every, positives=5, negatives_=10):
    """Plain Python; rows with unusable vectors are left out, each row is itself."""
    width = max((len(v) for _, _, v in rows if v is not None), default=0)
    usable = []
    for vec_id, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        usable.append((vec_id, label, q + [0] * (width - len(q))))
    out = []
    last = lambda i: (i is None, i or 0)
    for a, (anchor, label, q) in enumerate(usable):
        if anchor is None or anchor % every:
            continue
        score = [sum(x * y for x, y in zip(q, o[2])) for o in usable]
        order = sorted((k for k in range(len(usable)) if k != a), key=lambda k: (-score[k], last(usable[k][0])))
        for p in [k for k in order if usable[k][1] == label][:positives]:
            fit = [k for k in order if usable[k][1] != label and 30 * score[p] <= 100 * score[k] <= 90 * score[p]]
            out += [(anchor, usable[p][0], rank, usable[k][0], score[p], score[k])
                    for rank, k in enumerate(fit[:negatives_], 1)]
    return sorted(out, key=str)


def mined(df, every, **kw):
    return sorted((tuple(r) for r in negatives.mine(df, F.col("vec_id") % every == 0, **kw).collect()), key=str)


def clustered(n, width, centres=6):
    c = RNG.normal(size=(centres, width))
    v = c[RNG.integers(0, centres, n)] + 0.4 * RNG.normal(size=(n, width))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(i, int(RNG.integers(0, 4)), [float(x) for x in np.float32(v[i])]) for i in range(n)]


def test_equals_all_products(spark, monkeypatch):
    # many small trees, so that tiles, waves and the queue all act
    for name, value in {"TREE_ROWS": 60, "LEAF": 8, "FANOUT": 3, "BLOCK_ANCHORS": 20, "TOGETHER": 8, "SAMPLE": 200}.items():
        monkeypatch.setattr(negatives, name, value)
    rows = clustered(900, 12)
    v = rows[0][2]
    rows += [(1000 + i, i % 3, v) for i in range(300)]  # a fourth of all vectors are equal
    rows += [(2000, None, v), (2001, 1, None), (2002, 1, [None] * 12), (2010, 1, [float("nan")] * 12),
             (2020, 1, [float("-inf")] * 12), (None, 1, v), (20, 2, v), (20, 2, v), (2030, 2, v[:5]), (2040, 0, [])]
    assert mined(table(spark, rows), 20) == expected(rows, 20)


def test_ties_and_negative_scores(spark):
    rows = [(i, i % 2, [0.5, -0.5]) for i in range(40)] + [(100, 0, [-1.0, 1.0]), (110, 3, [0.5, 0.5]), (120, 0, [0.0, 0.0])]
    rows += [(200 + i, 1, [0.25, -0.25]) for i in range(20)]
    assert mined(table(spark, rows), 10) == expected(rows, 10)


def test_integers_beyond_doubles(spark):
    rows = [(i, i % 2, [float(2 ** 19 + i * 64), 3.0 + i]) for i in range(60)]
    assert mined(table(spark, rows), 10) == expected(rows, 10)
    with pytest.raises(ValueError):
        mined(table(spark, [(0, 1, [1e30])]), 10)


def test_no_rows_no_anchors(spark):
    assert mined(spark.createDataFrame([], SCHEMA), 10) == []
    assert mined(table(spark, [(1, 1, [1.0]), (None, 1, [1.0])]), 10) == []
    assert mined(table(spark, [(10, 1, [1.0])]), 10) == []


def test_boxes_go_unopened(spark):
    """Far boxes are pruned: on clustered vectors most leaves stay closed."""
    q = np.floor(256 * np.array([r[2] for r in clustered(4096, 8)]))
    leaves = negatives.pack(q, list(range(8)), np.arange(len(q)))
    assert sorted(np.concatenate(leaves).tolist()) == list(range(len(q))) and max(map(len, leaves)) <= negatives.LEAF
    order, cuts = np.concatenate(leaves), np.cumsum([0, *map(len, leaves[:-1])])
    tree = object.__new__(negatives.Tree)
    tree.q, tree.id, tree.row, tree.label = q[order], order, order, np.zeros(len(q), dtype=np.int64)
    tree.levels, tree.cuts = negatives.boxes(q[order], cuts), np.append(cuts, len(q))
    one = np.zeros(1, dtype=np.int64)
    queries = negatives.Queries(q[:1], one, one, one, one - negatives.FAR + 1, one + negatives.FAR, 5, True)
    opened, leaf = [], queries._leaf
    queries._leaf = lambda t, rows, live: (opened.append(rows), leaf(t, rows, live))
    queries.search(tree)
    score = q @ q[0]
    best = sorted((k for k in range(1, len(q))), key=lambda k: (-score[k], k))[:5]
    assert queries.id[0].tolist() == best and len(opened) < len(leaves) / 2
