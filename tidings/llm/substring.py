"""Substring deduplication by difference-cover anchors.

A word goes where a window of ``window`` words covers it whose word sequence
also starts earlier: in a document of smaller id, or earlier in the same one.

A difference cover D of a period v holds, for every distance, two members that
far apart modulo v.  So of any two equal windows, at starts i and j, some
offset below v puts both i + offset and j + offset on cover positions (those
whose place modulo v is in D).  With anchors of window - v + 1 words, hashed at
cover positions only, every pair of equal windows shares such an aligned
anchor.  Only windows around anchors that occur twice are looked at further:

1. anchors: one pass hashes them, and those that occur once drop out;
2. extension: the texts that hold the others are read again, and the complete
   windows around these anchors are hashed (96 bits) and meet their equals;
   all but the first one are removed;
3. the texts that lose words are read again and cut.

Hashes meet in buckets.  A task first settles what it can alone (an anchor it
has twice is shared, a window it has earlier is removed) and sends each hash
once, so a bucket gets a hash at most once from each task's piece of the
table, however many texts hold it.  Texts that are equal are told by their
hashes first: all but the one of smallest id have every window earlier.

Edge cases: null, empty and blank texts have no words and an empty kept text;
a text shorter than a window keeps all words; ids are integers, a null id
comes after all others; rows of one id with different texts are ordered by a
hash of the text; of rows equal in id and text the first stays, the others are
copies; very long texts are read whole, words of any length are hashed whole;
extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, stage
from .tokens import ONE, mix, pieces, token_hashes

WINDOW = 20
#: perfect difference covers by period (fixed values): every distance occurs exactly once
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: an anchor of fewer words than this meets too many strangers
LEAST_ANCHOR = 6
#: bytes of text that a task hashes at a time
PIECE = 8 << 20
#: words of the table per bucket, at most
BUCKET_WORDS = 1 << 20
LAST = (1 << 63) - 1

SPACE = np.zeros(256, dtype=np.uint8)
SPACE[[0x20, *range(0x09, 0x0E)]] = 1
WORD = 1 - SPACE


def cover(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, cover, words of an anchor) for a window."""
    v = max((v for v in COVERS if window - v + 1 >= LEAST_ANCHOR), default=1)
    return v, COVERS[v], window - v + 1


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, text after text, and the number of words of each text."""
    h, _, n = token_hashes(texts, WORD)
    return h, n


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on (fewer places than words)."""
    done = 1
    while done < k:
        step = min(done, k - done)
        h = mix(h[:max(len(h) - step, 0)] * ONE + h[step:])
        done += step
    return h


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values))


#: what a piece sends to a bucket: ``sure`` places are found already, the others wait for the other pieces
SENT = "bucket int, sure boolean, h array<long>, h2 array<int>, id array<long>, tie array<long>, pos array<int>"
FOUND = "id long, tie long, pos array<int>"


def _sent(sure: bool, buckets: int, h, h2, id, tie, pos) -> pa.RecordBatch:
    """Rows of SENT, one per bucket that occurs."""
    where = (h % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(where, kind="stable")
    names, cuts = np.unique(where[order], return_index=True)
    cuts = np.append(cuts, len(order)).astype(np.int32)
    columns = [_lists(c[order], cuts) for c in (h.view(np.int64), h2, id, tie, pos)]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([sure] * len(names), pa.bool_()), *columns],
                                      names=["bucket", "sure", "h", "h2", "id", "tie", "pos"])


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, group number, first place) of rows sorted by keys, most important key first; groups by the first two."""
    order = np.lexsort(keys[::-1])
    a, b = keys[0][order], keys[1][order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def _shared(h, h2, id, tie, pos) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors have an equal, and which go on for all their equals."""
    order, group, first = _groups(h, h2)
    many = np.empty(len(h), dtype=bool)
    many[order] = np.bincount(group, minlength=len(first))[group] > 1
    speaks = np.zeros(len(h), dtype=bool)
    speaks[order[first]] = True
    return many, speaks


def _later(h, h2, id, tie, pos) -> tuple[np.ndarray, np.ndarray]:
    """Which windows have an earlier equal, and which are the first of their equals."""
    order, group, first = _groups(h, h2, id, tie, pos)
    later, speaks = np.ones(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
    later[order[first]], speaks[order[first]] = False, True
    return later, speaks


def _places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, row, place in the text, words left in the text) of every word."""
    h, n = word_hashes(batch.column("text"))
    start = np.cumsum(n) - n
    row = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(h)) - start[row]
    return h, row, pos, n[row] - pos


def _meet(texts: DataFrame, pick: Callable, decide: Callable, buckets: int) -> DataFrame:
    """Places (FOUND) whose hash ``decide`` tells from its equals in the whole table.

    ``pick`` gives the places of a batch with their hashes.  ``decide`` is
    used twice: by a piece on its own places, and by a bucket on those sent.
    """

    def send(batches):
        for b in pieces(batches, PIECE):
            at, h, h2, row, pos = pick(b)
            id, tie = (b.column(c).to_numpy(zero_copy_only=False)[row] for c in ("id", "tie"))
            found, speaks = decide(h, h2, id, tie, pos)
            if found.any():
                yield _sent(True, buckets, h[found], h2[found], id[found], tie[found], pos[found])
            told = np.where(found, -1, pos)[speaks].astype(np.int32)  # a place found already only tells of its hash
            if speaks.any():
                yield _sent(False, buckets, h[speaks], h2[speaks], id[speaks], tie[speaks], told)

    def settle(table: pa.Table) -> pa.Table:
        flat = lambda t: [pc.list_flatten(t.column(c)).to_numpy() for c in ("h", "h2", "id", "tie", "pos")]
        done, rest = flat(table.filter(table.column("sure"))), flat(table.filter(pc.invert(table.column("sure"))))
        found = decide(*rest)[0] & (rest[4] >= 0)
        id, tie, pos = (np.concatenate([d, r[found]]) for d, r in zip(done[2:], rest[2:]))
        order, group, first = _groups(id, tie, pos)
        cuts = np.append(first, len(order))
        return pa.table({"id": id[order[first]], "tie": tie[order[first]], "pos": _lists(pos[order], cuts)})

    met = texts.mapInArrow(send, SENT).groupBy("bucket").applyInArrow(settle, FOUND)
    return stage(met.groupBy("id", "tie").agg(F.flatten(F.collect_list("pos")).alias("pos")))  # a text's own places


def _anchors(window: int) -> Callable:
    period, members, words = cover(window)

    def pick(batch):
        h, row, pos, left = _places(batch)
        keys = rolled(h, words)
        n = len(keys)
        at = np.flatnonzero((left[:n] >= window - period + 1) & np.isin(pos[:n] % period, members))
        return at, keys[at], np.zeros(len(at), dtype=np.int32), row[at], pos[at].astype(np.int32)
    return pick


def _windows(window: int) -> Callable:
    """The windows that contain a shared anchor, whose places come in the column ``near``."""
    period = cover(window)[0]

    def pick(batch):
        h, row, pos, left = _places(batch)
        near = batch.column("near")
        n_near = pc.list_value_length(near).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.searchsorted(row, np.arange(len(batch)))
        anchors = pc.list_flatten(near).to_numpy() + np.repeat(starts, n_near)
        low = np.maximum(anchors - period + 1, np.repeat(starts, n_near))
        edge = np.zeros(len(h) + 1, dtype=np.int64)
        np.add.at(edge, low, 1)
        np.add.at(edge, anchors + 1, -1)
        keys = rolled(h, window)
        n = len(keys)
        at = np.flatnonzero((np.cumsum(edge)[:n] > 0) & (left[:n] >= window))
        second = rolled(mix(h ^ ONE), window)[at].astype(np.uint32).view(np.int32)
        return at, keys[at], second, row[at], pos[at].astype(np.int32)
    return pick


def _cut(window: int) -> Callable:
    """Words, removed words and kept text; ``pos`` holds the starts of removed windows, null for none."""

    def run(batches):
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, starts in zip(b.column("text").to_pylist(), b.column("pos")):
                words = (text or b"").split()
                gone = 0
                if starts.is_valid and len(starts.values):
                    edge = np.zeros(len(words) + window + 1, dtype=np.int64)
                    at = starts.values.to_numpy()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    covered = np.cumsum(edge)[:len(words)] > 0
                    gone = int(covered.sum())
                    words = [w for w, c in zip(words, covered) if not c]
                n_words.append(len(words) + gone)
                n_removed.append(gone)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.binary())], names=["id", "doc_id", "n_words", "n_removed", "kept_text"])
    return run


def _with(texts: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """The texts that ``found`` names, with its places as a column; the others do not travel."""
    keys = found.select("id", "tie")
    if keys.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(keys), ["id", "tie"], "left_semi")
    return texts.join(found.withColumnRenamed("pos", name), ["id", "tie"])


def _without(texts: DataFrame, found: DataFrame) -> DataFrame:
    keys = found.select("id", "tie")
    return texts.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, ["id", "tie"], "left_anti")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    kind = df.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must hold integers, not {kind}")
    rows = (df.select(F.col(id_col).alias("doc_id"), F.col(text).cast("binary").alias("text"))
              .withColumn("id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)))
              .withColumn("tie", F.xxhash64("text")).withColumn("tie2", F.xxhash64(F.lit(2), F.col("text"))))
    # texts that occur more than once, the id that keeps them, and how many equal rows that id has
    same = (rows.groupBy("tie", "tie2", "id").agg(F.count(F.lit(1)).alias("n"))
                .groupBy("tie", "tie2").agg(F.min("id").alias("keeper"), F.min_by("n", "id").alias("twins"), F.sum("n").alias("n")))
    same = stage(same.filter("n > 1").drop("n"))
    small = same.count() <= BROADCAST_IDS
    marked = rows.join(F.broadcast(same) if small else same, ["tie", "tie2"], "left").drop("tie2")
    columns = ["id", "tie", "doc_id", "text"]
    heads = marked.filter("keeper is null or (id = keeper and twins = 1)").select(columns)
    copies = marked.filter("id > keeper").select(columns)
    if not same.filter("twins > 1").isEmpty():
        twins = marked.filter("id = keeper and twins > 1").dropDuplicates(["id", "tie"])
        heads = heads.unionByName(twins.select(columns))
        copies = copies.unionByName(twins.withColumn("copy", F.explode(F.sequence(F.lit(2), "twins"))).select(columns))

    size = heads.select(F.sum(F.octet_length("text"))).first()[0] or 0  # a word and its space take two bytes at least
    buckets = size // (2 * BUCKET_WORDS) + 1
    shared = _meet(heads.drop("doc_id"), _anchors(window), _shared, buckets)
    removed = _meet(_with(heads.drop("doc_id"), shared, "near"), _windows(window), _later, buckets)

    result = f"id long, doc_id {kind}, n_words long, n_removed long, kept_text binary"
    none = F.lit(None).cast("array<int>")
    whole = _without(heads, removed).withColumn("pos", none).mapInArrow(_cut(window), result)
    partly = _with(heads, removed, "pos").select("id", "doc_id", "text", "pos").mapInArrow(_cut(window), result)
    again = (copies.withColumn("pos", none).mapInArrow(_cut(window), result)
                   .withColumn("n_removed", F.when(F.col("n_words") >= window, F.col("n_words")).otherwise(F.lit(0)))
                   .withColumn("kept_text", F.when(F.col("n_words") >= window, F.lit("").cast("binary")).otherwise(F.col("kept_text"))))
    return (whole.unionByName(partly).unionByName(again)
                 .select("doc_id", "n_words", "n_removed", F.col("kept_text").cast("string").alias("kept_text")))
