"""Benchmark decontamination by winnowing, in built-in column functions only.

A span of ``t`` words is protected by fingerprints: every text is hashed in
k-grams, and in each run of ``w`` neighbouring k-grams (k + w - 1 = t) the
smallest hash is kept.  Two texts that share ``t`` words share all k-grams of
one such run, so both keep its smallest hash: no shared span is missed.
Documents and benchmark items join on kept hashes; each hit is then extended
word by word to both sides, and counts only if the shared run reaches ``t``
words, so hash collisions drop out.

An item of fewer than ``SPAN`` words is one span of its own length; documents
get fingerprints for each span length that the benchmark holds (ten lengths at
most).

Edge cases: null or empty texts have no words, are never hit and hold no span;
an empty benchmark leaves every document clean; rows that share an id pool
their hits (equal rows get equal results); repeated items count by item id
once; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_WORD, ascii_lower, let, stage, words

SPAN = 10
#: rows of a benchmark's fingerprints, or document ids, that may be broadcast
#: (about 60 MB); beyond, the joins shuffle
BROADCAST_ROWS = 200_000
#: separators of a text whose capitals are still there
NON_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _gram_hashes(ws: Column, n: Column, k: int) -> Column:
    gram = lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(k)])
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), gram))


def _kept(h: Column, w: int) -> Column:
    """Positions whose hash is the smallest of some full run of ``w`` hashes."""
    n = F.size(h)
    if w == 1:
        return F.when(n >= 1, F.sequence(F.lit(0), n - 1))
    least = F.when(n >= w, F.transform(F.sequence(F.lit(0), n - w),
                                       lambda i: F.least(*[F.get(h, i + j) for j in range(w)])))

    def pick(m: Column) -> Column:
        smallest = lambda p: F.get(h, p) == F.greatest(*[F.get(m, p - j) for j in range(w)])
        return F.when(m.isNotNull(), F.filter(F.sequence(F.lit(0), n - 1), smallest))
    return let(least, pick)


def fingerprints(ws: Column, span: int) -> Column:
    """Kept k-grams of a word array with position, hash and the words around."""
    k = (span + 1) // 2
    reach = span - k

    def entry(h: Column):
        def one(p: Column) -> Column:
            before = F.least(p, F.lit(reach))
            return F.struct(p.alias("p"), F.get(h, p).alias("h"), F.slice(ws, p + 1, k).alias("gram"),
                            F.slice(ws, p - before + 1, before).alias("left"), F.slice(ws, p + k + 1, reach).alias("right"))
        return one
    return let(_gram_hashes(ws, F.size(ws), k), lambda h: F.transform(_kept(h, span - k + 1), entry(h)))


def _run(a: Column, b: Column, reach: int, from_end: bool) -> Column:
    """How many words of two arrays agree, counted from the near end."""
    at = lambda c, j: F.get(c, F.size(c) - 1 - j if from_end else F.lit(j))
    agree = F.lit(reach)
    for j in reversed(range(reach)):
        agree = F.when(F.coalesce(at(a, j) == at(b, j), F.lit(False)), agree).otherwise(F.lit(j))
    return agree


def _shifted(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.size(a))


def _doubling(a: Column, n: int, join, body, overlap: bool) -> Column:
    """``join`` over each run of ``n`` neighbours of ``a``, from runs of powers
    of two; two runs that make up ``n`` may overlap if the join allows it."""
    p = 1 << (n.bit_length() - 1)

    def grow(runs: dict[int, Column], size: int) -> Column:
        if size < p:
            return let(F.zip_with(runs[size], _shifted(runs[size], size), join), lambda r: grow({**runs, 2 * size: r}, 2 * size))
        if overlap:
            return body(F.zip_with(runs[p], _shifted(runs[p], n - p), join) if n > p else runs[p])
        done, value = p, runs[p]
        for q in sorted((q for q in runs if n - p & q), reverse=True):
            value = F.zip_with(value, _shifted(runs[q], done), join)
            done += q
        return body(value)
    return grow({1: a}, 1)


def kept_hashes(ws: Column, span: int) -> Column:
    """Distinct kept hashes of a word array, without positions: sliding hashes
    and sliding minima by doubling, which is a few steps per word."""
    k = (span + 1) // 2
    n = F.size(ws)
    minima = lambda h: _doubling(F.slice(h, 1, n - k + 1), span - k + 1, lambda x, y: F.least(x, y),
                                 lambda m: F.array_distinct(F.slice(m, 1, n - span + 1)), True)
    hashed = let(F.transform(ws, lambda w: F.xxhash64(w)),
                 lambda wh: _doubling(wh, k, lambda x, y: F.xxhash64(x, y), lambda h: let(h, minima), False))
    return F.when(n >= span, hashed)


def _touched(docs: DataFrame, items: DataFrame, spans: list[int]) -> DataFrame:
    """Ids of the documents that keep any hash of the benchmark."""
    split = lambda df, also: df.select(*also, words(ascii_lower(F.col("text")), NON_WORD).alias("ws"))
    found = None
    for t in spans:
        own = split(items.filter(F.col("span") == t), [])
        bench = stage(own.select(F.explode(kept_hashes(F.col("ws"), t)).alias("h")).distinct())
        small = bench.count() <= BROADCAST_ROWS
        ours = split(docs, ["doc_id"]).select("doc_id", F.explode(kept_hashes(F.col("ws"), t)).alias("h"))
        ids = ours.join(F.broadcast(bench) if small else bench, "h", "left_semi").select("doc_id")
        found = ids if found is None else found.unionByName(ids)
    return stage(found.distinct())


def _spans(docs: DataFrame, items: DataFrame, span: int) -> DataFrame:
    """(doc_id, item_id, start, end) of shared runs of at least ``span`` words."""
    k = (span + 1) // 2
    bench = stage(items.select("item_id", F.explode(let(F.col("ws"), lambda ws: fingerprints(ws, span))).alias("b"))
                       .select("item_id", "b.h", "b.gram", "b.left", "b.right").distinct())  # places do not matter: repeats meet once
    if bench.count() <= BROADCAST_ROWS:
        bench = F.broadcast(bench)
    ours = docs.select("doc_id", F.explode(let(F.col("ws"), lambda ws: fingerprints(ws, span))).alias("d"))
    hits = ours.join(bench, F.col("d.h") == F.col("h")).filter(F.col("d.gram") == F.col("gram"))
    left = _run(F.col("d.left"), F.col("left"), span - k, True)
    right = _run(F.col("d.right"), F.col("right"), span - k, False)
    runs = hits.select("doc_id", "item_id", F.col("d.p").alias("p"), left.alias("l"), right.alias("r"))
    return runs.filter(F.col("l") + F.col("r") + k >= span).select(
        "doc_id", "item_id", (F.col("p") - F.col("l")).alias("s"), (F.col("p") + k + F.col("r")).alias("e"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
                  item_col: str = "item_id", item_text: str = "text", span: int = SPAN) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted as strings)."""
    split = words(ascii_lower(F.col("text")), NON_WORD).alias("ws")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    totals = texts.select("doc_id", F.size(words(F.col("text"), NON_WORD_ANY_CASE)).cast("bigint").alias("n_words"))
    items = (benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
                      .select("item_id", "text", split).filter(F.size("ws") > 0)
                      .withColumn("span", F.least(F.size("ws"), F.lit(span))))
    lengths = sorted(r[0] for r in items.select("span").distinct().collect())  # ``span`` values at most
    found = None
    if lengths:
        touched = _touched(texts, items, lengths).select(F.col("doc_id").alias("_hit"))
        if touched.count() <= BROADCAST_ROWS:
            touched = F.broadcast(touched)
        ours = texts.join(touched, F.col("doc_id").eqNullSafe(F.col("_hit")), "left_semi").select("doc_id", split)
        for t in lengths:
            part = _spans(ours, items.filter(F.col("span") == t), t)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return totals.select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_hit"),
                             F.array().cast("array<string>").alias("items"))
    start = F.struct(F.lit(0).alias("to"), F.lit(0).cast("bigint").alias("n"))
    add = lambda a, x: F.struct(F.greatest(a["to"], x["e"]).alias("to"),
                                (a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["to"]), F.lit(0))).cast("bigint").alias("n"))
    per_doc = found.groupBy(F.col("doc_id").alias("_id")).agg(
        F.aggregate(F.array_sort(F.collect_set(F.struct("s", "e"))), start, add, lambda a: a["n"]).alias("n_hit"),
        F.array_sort(F.transform(F.collect_set("item_id"), lambda x: x.cast("string"))).alias("items"))
    return (totals.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
                  .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                          F.coalesce("items", F.array().cast("array<string>")).alias("items")))
