"""Quality selection by importance resampling.

Two generative models over hashed word n-grams (words and punctuation runs,
orders 1 and 2) are counted: one over target texts (labelled good), one over
the whole raw table.  A text's log weight is the sum over its n-grams of
log(p_target / p_raw).  Gumbel top-k sampling without replacement keeps the
``k`` rows with the largest log weight plus Gumbel noise; the noise is a hash
of the id, so a re-run selects the same rows.  The k-th key is found exactly
by radix selection: a few counting passes over key prefixes, no global sort.

The target sample is bounded by ``target_docs`` labelled rows (chosen by a
hash of the id); every count of the raw model covers all rows.  ``PRIOR``
counts of the raw model smooth the target model, and a target text is weighed
without its own counts, so labelled texts have no advantage.

Texts are cut into tokens on their bytes, a piece of the table at a time.

Edge cases: null or empty text has no n-grams and log weight 0; rows with
equal ids and texts have equal keys and are kept or left together (so ties at
the k-th key are all kept); very long texts count whole; a null id is no
target; extra columns are not read; empty tables give no rows; without any
target text the models are equal and only the noise decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kth_largest, stage, to_arrays
from .tokens import ONE, TWO, mix, pieces, token_hashes

BUCKETS = 1 << 17
PRIOR = 1.0
#: bytes of text that a task weighs at a time
PIECE = 8 << 20
#: tokens: words (1) or runs of ASCII punctuation (2); the other bytes separate
TOKEN = np.zeros(256, dtype=np.uint8)
TOKEN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = 1
TOKEN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 2


def ngram_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of the unigrams, then of the bigrams, of all texts; A-Z count as a-z."""
    h, _, n = token_hashes(texts, TOKEN, lower=True)
    row = np.repeat(np.arange(len(n)), n)
    both = row[1:] == row[:-1]
    pairs = mix((h[:-1] * ONE) ^ (h[1:] + TWO))[both]
    return (np.concatenate([h, pairs]) >> np.uint64(64 - 17)).astype(np.int64), np.concatenate([row, row[1:][both]])


def marked_texts(df: DataFrame, good_ids: DataFrame, id_col: str, text: str, target_docs: int) -> DataFrame:
    """Id, text bytes, and whether the row is one of about ``target_docs`` target texts."""
    n_good = good_ids.count()
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit("target")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    target = (good_ids.filter(chance < F.lit(target_docs / max(n_good, 1)))
                      .select(F.col(id_col).alias("_target")).distinct())
    return (df.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text"))
              .join(F.broadcast(target), F.col("id") == F.col("_target"), "left")  # about target_docs ids
              .select("id", "text", F.col("_target").isNotNull().alias("good")))


def fit(marked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Per bucket: n-grams of the target texts, and how many the raw model expects of them."""

    def count(batches):
        raw, good = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for b in pieces(batches, PIECE):
            bucket, row = ngram_buckets(b.column("text"))
            raw += np.bincount(bucket, minlength=BUCKETS)
            is_good = b.column("good").to_numpy(zero_copy_only=False)
            good += np.bincount(bucket[is_good[row]], minlength=BUCKETS)
        at = np.nonzero(raw)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])

    counts = to_arrays(marked.select("text", "good").mapInArrow(count, "bucket long, raw long, good long")
                             .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")))  # BUCKETS rows at most
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["bucket"]] += counts["raw"]
    good[counts["bucket"]] += counts["good"]
    expected = raw / max(raw.sum(), 1) * good.sum()  # of the target, were it like the raw text
    return good, expected


def weigher(good: np.ndarray, expected: np.ndarray):
    """Log weight of every text of a task."""
    ratio = np.log((good + PRIOR) / (expected + PRIOR))

    def weigh(batches):
        for b in pieces(batches, PIECE):
            bucket, row = ngram_buckets(b.column("text"))
            weight = np.bincount(row, ratio[bucket], minlength=len(b))
            own = b.column("good").to_numpy(zero_copy_only=False)  # target texts are judged by the others
            pairs, n = np.unique(row[own[row]] * BUCKETS + bucket[own[row]], return_counts=True)
            g = pairs % BUCKETS
            judged = np.bincount(pairs // BUCKETS, n * np.log((good[g] - n + PRIOR) / (expected[g] + PRIOR)), minlength=len(b))
            weight[own] = judged[own]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(weight)], names=["id", "log_weight"])
    return weigh


def resample(df: DataFrame, good_ids: DataFrame, k: int, id_col: str = "doc_id", text: str = "text",
             target_docs: int = 50_000, seed: int = 17) -> DataFrame:
    """One row per input row: id, log_weight, sample_key, selected."""
    marked = marked_texts(df, good_ids, id_col, text, target_docs)
    kind = marked.schema["id"].dataType.simpleString()
    weights = marked.mapInArrow(weigher(*fit(marked)), f"id {kind}, log_weight double").withColumnRenamed("id", id_col)
    uniform = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    scored = stage(weights.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(uniform))))
    least = kth_largest(scored, "sample_key", k)
    chosen = F.lit(False) if least is None else F.col("sample_key") >= F.lit(least)
    return scored.withColumn("selected", chosen)
