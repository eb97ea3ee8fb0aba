"""Near-duplicate links by an n-gram Jaccard join with rare-first prefix filtering.

A text is the set of its distinct 5-word shingles (64-bit hashes).  Texts with
equal sets form one class, and one member stands for it.  Each class orders its
shingles rare first (by a hashed frequency table over all shingles, ties by
hash: one order for all, so the filters are exact whatever the table holds)
and keeps a prefix so long that two sets at the threshold must share a prefix
shingle.  Classes meet in the posting lists of prefix shingles.  A pair in a
list survives only if

* length: the smaller set can cover the share of the larger,
* position: the shingles from the shared one on can still reach the overlap,
* suffix: the sets' 256-bit parity sketches do not differ in more bits than the
  two sets may differ in shingles,

and each surviving pair is verified once, on the complete sets.

A group of near copies shares its posting lists, so links are found in two
rounds.  First each list names one pivot, the class with the fewest rarer
shingles, and each class is compared with the few pivots it meets most often:
pairs grow as list entries do.  Then only classes of one list that are still in
different components are compared, all of them.  A pair skipped in this way
lies inside a component already, so components are exact while no group is
expanded into all its pairs.  ``near_duplicates`` needs no more than that.
``near_links`` is the complete join: it verifies every candidate pair of
classes, long lists cut into blocks that meet block by block, and gives all
links; its work grows with the number of links.

Edge cases: a text of fewer words than a shingle is one shingle; null, empty
or blank texts have none, link with nothing and are their own component; a null
id is never linked; rows are told apart by text, so rows of one id may differ;
extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import SPACES, ascii_lower, small_batches, stage, to_arrays, words
from .components import components

SHINGLE = 5
PERCENT = 80
#: slots of the frequency table (a fixed size; it orders shingles, nothing more)
SLOTS = 1 << 18
SKETCH_WORDS = 4
SKETCH = [f"k{i}" for i in range(SKETCH_WORDS)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(word_hashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a word hash array."""
    w = np.asarray(word_hashes, dtype=np.int64).view(np.uint64)
    if not len(w):
        return w
    k = min(SHINGLE, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[j:len(w) - k + 1 + j])
    return np.unique(h)


def prefix_size(n: int) -> int:
    """Shingles of the prefix: n less the least overlap with any partner, plus one."""
    return n - -(-PERCENT * n // 100) + 1


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the shingle count in each of 64 * SKETCH_WORDS hash classes, as bit words."""
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) % (64 * SKETCH_WORDS), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128-bit name of a shingle set; equal sets have equal names."""
    both = [_mix(s).sum(dtype=np.uint64), _mix(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)]
    return tuple(int(x.astype(np.int64)) for x in both)


def _summaries(frequency: np.ndarray):
    def run(batches):
        for b in batches:
            rows = []
            for doc_id, h in zip(b["doc_id"], b["words"]):
                s = shingle_set(h)
                order = np.argsort(frequency[(s & np.uint64(SLOTS - 1)).astype(np.int64)], kind="stable")
                rows.append((doc_id, len(s), *fingerprint(s), *sketch(s),
                             s[order[:prefix_size(len(s))]].view(np.int64) if len(s) else []))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "c1", "c2", *SKETCH, "prefix"])
    return run


def _sets(batches):
    for b in batches:
        sets = [shingle_set(h) for h in b["words"]]
        names = [fingerprint(s) for s in sets]
        yield pd.DataFrame({"c1": [x for x, _ in names], "c2": [y for _, y in names],
                            "shingles": [s.view(np.int64) for s in sets]})


def frequency_table(hashed: DataFrame) -> np.ndarray:
    """How many (text, shingle) pairs fall in each of SLOTS hash slots, over all texts."""

    def count(batches):
        n = np.zeros(SLOTS, dtype=np.int64)
        for b in batches:
            found = [shingle_set(h) & np.uint64(SLOTS - 1) for h in b["words"]]
            if found:
                n += np.bincount(np.concatenate(found).astype(np.int64), minlength=SLOTS)
        at = np.nonzero(n)[0]
        yield pd.DataFrame({"slot": at.astype(np.int32), "n": n[at]})

    rows = to_arrays(hashed.select("words").mapInPandas(count, "slot int, n long")
                           .groupBy("slot").agg(F.sum("n").alias("n")))  # SLOTS rows at most
    table = np.zeros(SLOTS, dtype=np.int64)
    table[rows["slot"]] = rows["n"]
    return table


def _least_overlap(na: Column, nb: Column) -> Column:
    """Least shared shingles of a linked pair of these sizes."""
    return F.ceil((PERCENT * (na + nb)) / F.lit(100.0 + PERCENT))


def _entry_may_link(na: Column, pa: Column, nb: Column, pb: Column) -> Column:
    """Length and position filter of two entries of one list."""
    return ((100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb))
            & (F.least(na - pa, nb - pb) >= _least_overlap(na, nb)))


def _sketch_may_link(a: str, b: str, na: Column, nb: Column) -> Column:
    """Suffix filter: parity bits that differ are shingles that differ."""
    differ = sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in SKETCH[1:]),
                 F.bit_count(F.col(f"{a}{SKETCH[0]}").bitwiseXOR(F.col(f"{b}{SKETCH[0]}"))))
    return differ <= na + nb - 2 * _least_overlap(na, nb)


#: pivots a class is compared with in the first round; the second round is complete whatever this is
PIVOTS = 3
#: class representatives that may be broadcast to fetch their texts (about 30 MB); beyond, by shuffle
BROADCAST_ROWS = 1_000_000


def _verified(pairs: DataFrame, summary: DataFrame, hashed: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes, each checked once on the complete sets, which
    are built anew for the classes of the pairs only."""
    wanted = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
    wanted = stage(summary.select("row", "doc_id", "c1", "c2").join(wanted, "row", "left_semi"))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = hashed.join(wanted.select("doc_id"), "doc_id", "left_semi").select("words")
    sets = stage(texts.mapInPandas(_sets, "c1 long, c2 long, shingles array<long>")
                      .join(wanted.select("row", "c1", "c2"), ["c1", "c2"]).select("row", "shingles"))
    side = lambda x: sets.select(F.col("row").alias(x), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return (both.filter((100 + PERCENT) * shared >= PERCENT * (F.size("sa") + F.size("sb"))).select("a", "b").distinct())


#: entries of one block of a posting list in the complete join
BLOCK = 1000


def _classes(df: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(hashed words, row summaries, rows that can link, prefix entries of one row per class)."""
    hashed = small_batches(df).select(F.col(id_col).alias("doc_id"),
                       F.transform(words(ascii_lower(F.col(text)), SPACES), lambda w: F.xxhash64(w)).alias("words"))
    kind = hashed.schema["doc_id"].dataType.simpleString()
    sketches = ", ".join(f"{k} long" for k in SKETCH)
    summary = stage(hashed.mapInPandas(_summaries(frequency_table(hashed)),
                                       f"doc_id {kind}, n int, c1 long, c2 long, {sketches}, prefix array<long>")
                          .withColumn("row", F.monotonically_increasing_id()))
    real = summary.filter("n > 0 and doc_id is not null")
    # classes: the first row of all that have the same set stands for them
    entries = (real.groupBy("c1", "c2").agg(F.min(F.struct("row", "n", "prefix")).alias("r"))
                   .select(F.col("r.row").alias("row"), F.col("r.n").alias("n"), F.posexplode("r.prefix").alias("pos", "h"))
                   .select("h", "row", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")).alias("np")))
    return hashed, summary, real, entries


def near_links(df: DataFrame, id_col: str = "doc_id", text: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """All links: (members, pairs).

    Members has one row per input row: doc_id, n_shingles, class_id (null for
    rows that cannot link) and n_links, the number of other rows the row is
    linked with.  Pairs (a, b) has every two linked classes once, a < b; rows
    of one class are linked with each other besides.
    """
    hashed, summary, real, entries = _classes(df, id_col, text)
    sizes = entries.groupBy("h").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / F.lit(float(block))).cast("int")
    own = F.pmod(F.xxhash64("row", F.lit("block")), F.col("blocks")).cast("int")
    placed = (entries.join(sizes, "h").withColumn("blocks", blocks).withColumn("own", own)
                     .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                     .select("h", "row", F.shiftright("np", 32).alias("n"), F.col("np").bitwiseAND((1 << 32) - 1).alias("pos"),
                             "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
                     .join(summary.select("row", *SKETCH), "row"))
    placed = stage(placed)
    x, y = placed.alias("x"), placed.alias("y")
    meet = ((F.col("x.h") == F.col("y.h")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
            & (F.col("x.row") < F.col("y.row")) & (F.least("x.own", "y.own") == F.col("x.i"))
            & (F.greatest("x.own", "y.own") == F.col("x.j")))
    pairs = (x.join(y, meet & _entry_may_link(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"))
                    & _sketch_may_link("x.", "y.", F.col("x.n"), F.col("y.n")))
              .select(F.col("x.row").alias("a"), F.col("y.row").alias("b")).distinct())
    links = stage(_verified(stage(pairs), summary, hashed))

    name = F.concat(F.lpad(F.hex("c1"), 16, "0"), F.lpad(F.hex("c2"), 16, "0"))  # equal sets have equal names
    groups = stage(real.groupBy("c1", "c2").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("rows"))
                       .withColumn("class_id", name))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = (both.join(groups.select(F.col("row").alias("b"), "rows"), "b")
                  .groupBy(F.col("a").alias("row")).agg(F.sum("rows").alias("others")))
    of_class = (groups.join(linked, "row", "left")
                      .select("c1", "c2", "class_id", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    can_link = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    rows = summary.select("doc_id", "n", *[F.when(can_link, F.col(c)).alias(c) for c in ("c1", "c2")])
    members = rows.join(of_class, ["c1", "c2"], "left").select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    names = lambda c: groups.select(F.col("row").alias(c), F.col("class_id").alias(f"{c}_id"))
    pairs = (links.join(names("a"), "a").join(names("b"), "b")
                  .select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")))
    return members, pairs


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id."""
    hashed, summary, real, entries = _classes(df, id_col, text)
    n_of, pos_of = (lambda c: F.shiftright(F.col(c), 32)), (lambda c: F.col(c).bitwiseAND((1 << 32) - 1))
    of_list = Window.partitionBy("h")
    rarest = F.min(F.struct(pos_of("np").alias("pos"), "row", "np")).over(of_list)
    lists = stage(entries.withColumn("p", rarest).withColumn("size", F.count(F.lit(1)).over(of_list)).filter("size > 1")
                         .select("h", "row", "np", F.col("p.row").alias("prow"), F.col("p.np").alias("pnp")))
    marks = summary.select("row", *SKETCH)
    marked = lambda x: marks.select(F.col("row").alias(x), *[F.col(k).alias(f"{x}_{k}") for k in SKETCH])

    # first round: each class against the pivots it meets most often
    met = (lists.filter((F.col("prow") != F.col("row"))
                        & _entry_may_link(n_of("np"), pos_of("np"), n_of("pnp"), pos_of("pnp")))
                .groupBy("row", "prow", n_of("np").alias("n"), n_of("pnp").alias("pn")).agg(F.count(F.lit(1)).alias("times")))
    most = Window.partitionBy("row").orderBy(F.desc("times"), "prow")
    first = (met.withColumn("rank", F.row_number().over(most)).filter(F.col("rank") <= PIVOTS)
                .join(marked("row"), "row").join(marked("prow"), "prow")
                .filter(_sketch_may_link("row_", "prow_", F.col("n"), F.col("pn")))
                .select(F.least("row", "prow").alias("a"), F.greatest("row", "prow").alias("b")).distinct())
    first = stage(first)
    links = stage(_verified(first, summary, hashed))

    # second round: classes of one list that are still apart
    placed = (lists.select("h", "row", "np").join(components(links).withColumnRenamed("node", "row"), "row", "left")
                   .withColumn("component", F.coalesce("component", "row")))
    apart = (placed.withColumn("low", F.min("component").over(of_list)).withColumn("high", F.max("component").over(of_list))
                   .filter("low < high").select("h", "row", n_of("np").alias("n"), pos_of("np").alias("pos"), "component")
                   .join(marks, "row"))
    apart = stage(apart)
    x, y = apart.alias("x"), apart.alias("y")
    rest = (x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.component") < F.col("y.component"))
                   & _entry_may_link(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"))
                   & _sketch_may_link("x.", "y.", F.col("x.n"), F.col("y.n")))
             .select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b")).distinct()
             .join(first, ["a", "b"], "left_anti"))
    links = links.unionByName(_verified(stage(rest), summary, hashed))

    # components of classes, named by their smallest id, back to the rows
    linked = (real.groupBy("c1", "c2").agg(F.min("row").alias("row"), F.min("doc_id").alias("least"))
                  .join(components(links).withColumnRenamed("node", "row"), "row", "left")
                  .withColumn("component", F.coalesce("component", "row")))
    smallest = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = linked.join(smallest, "component").select("c1", "c2", "component_id")
    has_class = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    rows = summary.select("doc_id", "n", *[F.when(has_class, F.col(c)).alias(c) for c in ("c1", "c2")])
    return rows.join(of_class, ["c1", "c2"], "left").select("doc_id", F.col("n").cast("bigint").alias("n_shingles"),
                                                            F.coalesce("component_id", "doc_id").alias("component_id"))
