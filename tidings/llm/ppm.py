"""Language-model scoring by prediction by partial matching over bytes.

Training counts every (context, next byte) of the training texts, contexts
being the last 0 to ``ORDER`` bytes: a context trie, kept as one count table
per order.  A text's score is the log10 probability of its bytes and of its
end.  Each byte is coded in its longest known context; an escape (method C:
as many counts as the context has distinct symbols) moves to the next shorter
one, and symbols of the longer context are excluded there.  As every symbol
of a context is also one of its suffix, an exclusion is a sum known per
context, so scoring a byte takes one lookup per order.

All counts come from all training rows and none is left out.  The count table
stays in Spark: codes are dealt by their two nearest context bytes, so a task
holds every node of orders 2 and up it needs, and orders 0 and 1 (at most
66,000 nodes, whatever the input) go to all tasks.  Each distinct code of the
documents gets its exact probability there.  Probabilities of the ``hot_codes``
most frequent codes travel to the scoring tasks; all other codes join the
probability table by code, so the trie may grow without bound.

The word baseline beside it needs the training count of every word.  Counts of
the words above the ``HOT_WORDS``-th largest count travel to the tasks; all
other words join the count table by word, so the vocabulary may grow without
bound.

Edge cases: null text is empty (its end is still scored); an untrained model is
uniform; rows are scored one by one, so repeated ids and texts are fine; an
empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kth_largest, small_batches, stage, to_arrays

ORDER = 4
BITS = 9
START, END, SYMBOLS = 0, 257, 257
CHUNK_BYTES = 4_000_000
HOT_WORDS = 100_000
HOT_CODES = 2_000_000
#: codes of one task when probabilities are worked out, and distinct codes a counting task holds
TASK_CODES = 500_000
HELD_CODES = 4_000_000
#: orders whose nodes are few at any input size
LOW_ORDERS = 2


def symbol_codes(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Context-and-symbol code of every byte and end, and where each text starts.

    A code holds the symbol in its lowest ``BITS`` bits and above it the
    symbols before, nearest first; texts are preceded by ``START``.
    """
    pad = np.full(order, START, dtype=np.int64)
    parts = []
    for t in texts:
        parts += [pad, np.frombuffer(t, dtype=np.uint8).astype(np.int64) + 1, [END]]
    s = np.concatenate(parts)
    code = s.copy()
    for j in range(1, order + 1):
        code[j:] |= s[:-j] << (BITS * j)
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return code[s != START], starts


def lowered(texts) -> list[bytes]:
    return [(t or "").encode().lower() for t in texts]  # bytes.lower changes A-Z only


def chunks(texts: list[bytes]):
    """Slices of a batch of about CHUNK_BYTES; a longer text is a slice of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield at, i
            at, size = i, 0
        size += len(t)
    if texts:
        yield at, len(texts)


def count_codes(batches, order: int):
    """(code, n, m) of a partition: n counts training texts, m all; merged as they grow."""
    held: list[pd.DataFrame] = []
    for b in batches:
        texts, training = lowered(b["text"]), ~b["held_out"].to_numpy(dtype=bool)
        for is_training in (True, False):
            own = [t for t, x in zip(texts, training) if x == is_training]
            for a, z in chunks(own):
                code, _ = symbol_codes(own[a:z], order)
                m = pd.Series(code).value_counts(sort=False)
                held.append(pd.DataFrame({"n": m if is_training else 0, "m": m}, index=m.index))
                if len(held) == 16:
                    held = [pd.concat(held).groupby(level=0).sum()]
                    if len(held[0]) > HELD_CODES:
                        yield held.pop().rename_axis("code").reset_index()
    if held:
        yield pd.concat(held).groupby(level=0).sum().rename_axis("code").reset_index()


def _level(code: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of order k and their counts, from longer codes."""
    node, which = np.unique(code & ((1 << (BITS * (k + 1))) - 1), return_inverse=True)
    return node, np.bincount(which, weights=n, minlength=len(node))


@dataclass
class Trie:
    """Per order k: sorted codes and counts; sorted contexts with total, distinct and excluded sum."""
    order: int
    codes: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    distinct: list[np.ndarray]
    excluded: list[np.ndarray]

    @staticmethod
    def build(order: int, levels: list[tuple[np.ndarray, np.ndarray]]) -> Trie:
        trie = Trie(order, [], [], [], [], [], [])
        for k, (code, n) in enumerate(levels):
            by = np.argsort(code)
            code, n = code[by].astype(np.int64), n[by].astype(np.float64)
            context, start, distinct = np.unique(code >> BITS, return_index=True, return_counts=True)
            below = np.zeros(len(code))
            if k:
                shorter, at = _find(trie.codes[k - 1], code & ((1 << (BITS * k)) - 1))
                below = _take(trie.counts[k - 1], shorter, at)
            trie.codes.append(code)
            trie.counts.append(n)
            trie.contexts.append(context)
            trie.distinct.append(distinct)
            for target, value in ((trie.totals, n), (trie.excluded, below)):
                target.append(np.add.reduceat(value, start) if len(start) else np.zeros(0))
        return trie

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of the symbol of each full-order code in its context."""
        out = np.zeros(len(code))
        open_ = np.ones(len(code), dtype=bool)
        gone_n, gone_q = np.zeros(len(code)), np.zeros(len(code))
        for k in range(self.order, -1, -1):
            own = code & ((1 << (BITS * (k + 1))) - 1)
            known, at = _find(self.contexts[k], own >> BITS)
            total, distinct = _take(self.totals[k], known, at), _take(self.distinct[k], known, at)
            seen, place = _find(self.codes[k], own)
            fresh = distinct - gone_q
            room = total - gone_n + np.where(distinct < SYMBOLS, fresh, 0)
            hit = open_ & seen
            out[hit] += np.log10(self.counts[k][place[hit]] / room[hit])
            pass_on = open_ & known & ~seen & (fresh > 0)
            out[pass_on] += np.log10(fresh[pass_on] / room[pass_on])
            open_ &= ~seen
            gone_n, gone_q = _take(self.excluded[k], known, at), distinct
        out[open_] -= np.log10(SYMBOLS - gone_q[open_])
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(known, place) of wanted values in sorted keys."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted), dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def _take(values: np.ndarray, known: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where(known, values[at], 0).astype(np.float64) if len(values) else np.zeros(len(known))


def _counted(source: DataFrame, order: int) -> DataFrame:
    """(code, n, m) of all texts: how often a code occurs in training texts, and in all."""
    return (source.select("text", "held_out").mapInPandas(lambda b: count_codes(b, order), "code long, n long, m long")
                  .groupBy("code").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))


def code_logs(source: DataFrame, order: int) -> tuple[DataFrame, int]:
    """(code, m, log) of every distinct code of ``source`` (text, held_out), and how many there are.

    ``log`` is the code's log10 probability under the trie of all training texts.
    """
    counted = stage(_counted(source, order))
    distinct = counted.count()
    k = min(LOW_ORDERS - 1, order)
    node = F.col("code").bitwiseAND((1 << (BITS * (k + 1))) - 1)
    low = to_arrays(counted.filter("n > 0").groupBy(node.alias("code")).agg(F.sum("n").alias("n")))  # LOW_ORDERS orders only
    shared = source.sparkSession.sparkContext.broadcast((low["code"], low["n"]))

    def judge(batches):
        code, n, m = (np.concatenate(x) for x in zip(*[[b[c].to_numpy() for c in ("code", "n", "m")] for b in batches]
                                                     or [[np.zeros(0, dtype=np.int64)] * 3]))
        seen = n > 0
        trie = Trie.build(order, [_level(*(shared.value if k < LOW_ORDERS else (code[seen], n[seen])), k)
                                  for k in range(order + 1)])
        for a in range(0, len(code), CHUNK_BYTES // 8):
            part = slice(a, a + CHUNK_BYTES // 8)
            yield pd.DataFrame({"code": code[part], "m": m[part], "log": trie.log10(code[part])})

    tasks = max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-distinct // TASK_CODES))
    nearest = F.shiftright("code", BITS).bitwiseAND((1 << (BITS * LOW_ORDERS)) - 1)
    return stage(counted.repartition(tasks, nearest).mapInPandas(judge, "code long, m long, log double")), distinct


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) over all texts, words as lower-cased UTF-8 bytes."""

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in lowered(b["text"]):
                seen.update(t.split())
                if len(seen) > 1_000_000:
                    yield pd.DataFrame({"word": list(seen), "c": list(seen.values())})
                    seen.clear()
        yield pd.DataFrame({"word": list(seen), "c": list(seen.values())})

    return (docs.select(F.col(text).alias("text")).mapInPandas(count, "word binary, c long")
                .groupBy("word").agg(F.sum("c").alias("c")))


def score(docs: DataFrame, train_rows: Column, id_col: str = "doc_id", text: str = "text", order: int = ORDER,
          hot_codes: int = HOT_CODES, hot_words: int = HOT_WORDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    source = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"),
                         (~train_rows).alias("held_out"))
    training = source.filter(~F.col("held_out"))
    logs, distinct_codes = code_logs(source, order)
    most = logs
    if distinct_codes > hot_codes:
        bound = kth_largest(logs.select(F.col("m").cast("double").alias("m")), "m", hot_codes)
        most = logs.filter(F.col("m") > F.lit(bound))
    top = to_arrays(most.select("code", "log"))  # hot_codes rows at most
    by = np.argsort(top["code"])
    codes = (top["code"][by], top["log"][by])
    counts = stage(word_counts(training))
    ends = training.count()
    distinct, total = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    total, distinct = total + ends, distinct + (ends > 0)
    least = kth_largest(counts.select(F.col("c").cast("double").alias("c")), "c", hot_words)
    top = to_arrays(counts.filter(F.col("c") > F.lit(least)))  # fewer than hot_words rows
    hot = dict(zip(top["word"], np.log10(top["c"] + 1).tolist()))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((*codes, hot))  # plain arrays; limits as above
    end_log = float(np.log10(ends + 1))

    def judge(batches):
        hot_code, hot_log, hot = shared.value
        for b in batches:
            texts = lowered(b["text"])
            scores = np.zeros(len(texts))
            cold, cold_times = ([[]] * len(texts) for _ in range(2))
            for a, z in chunks(texts):
                code, starts = symbol_codes(texts[a:z], order)
                which, own = pd.factorize(code)
                known, at = _find(hot_code, own)
                scores[a:z] = np.add.reduceat(_take(hot_log, known, at)[which], starts)
                if known.all():
                    continue
                unknown = ~known[which]
                for i, start, end in zip(range(a, z), starts, [*starts[1:], len(code)]):
                    cold[i], cold_times[i] = np.unique(code[start:end][unknown[start:end]], return_counts=True)
            rows = []
            for t in texts:
                seen = Counter(t.split())
                known, logs, rare, times = 0, [], [], []
                for w, n in seen.items():
                    if (x := hot.get(w)) is None:
                        rare.append(w)
                        times.append(n)
                    else:
                        known += n
                        logs.append(n * x)
                rows.append((sum(seen.values()) + 1, known, sum(logs), rare, times))
            out = pd.DataFrame(rows, columns=["n_tokens", "hot_known", "hot_log", "rare", "times"])
            out.insert(0, "doc_id", b["doc_id"].array)
            out["cold"], out["cold_times"] = cold, cold_times
            out["held_out"], out["hot_score"] = b["held_out"].array, scores
            yield out

    kind = source.schema["doc_id"].dataType.simpleString()
    scored = stage(source.mapInPandas(judge, f"doc_id {kind}, n_tokens long, hot_known long, hot_log double, "
                                             "rare array<binary>, times array<long>, cold array<long>, "
                                             "cold_times array<long>, held_out boolean, hot_score double")
                         .withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.inline(F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("n"))))
    found = (rare.join(counts, "word").groupBy(F.col("row").alias("_row"))
                 .agg(F.sum("n").alias("known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("log")))
    known = F.col("hot_known") + F.coalesce("known", F.lit(0)) + F.lit(int(ends > 0))
    base = (F.col("hot_log") + F.coalesce("log", F.lit(0.0)) + F.lit(end_log)
            - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1))))
    if distinct_codes > hot_codes:
        cold = scored.select("row", F.inline(F.arrays_zip(F.col("cold").alias("code"), F.col("cold_times").alias("n"))))
        rest = (cold.join(logs, "code").groupBy(F.col("row").alias("_cold_row"))
                    .agg(F.sum(F.col("n") * F.col("log")).alias("cold_score")))
        scored = scored.join(rest, F.col("row") == F.col("_cold_row"), "left")
    else:
        scored = scored.withColumn("cold_score", F.lit(0.0))
    total_score = F.col("hot_score") + F.coalesce("cold_score", F.lit(0.0))
    return (scored.join(found, F.col("row") == F.col("_row"), "left")
                  .select("doc_id", "held_out", "n_tokens", known.cast("bigint").alias("n_known"),
                          F.lit(total).cast("bigint").alias("train_tokens"), base.alias("base_score"), total_score.alias("score")))
