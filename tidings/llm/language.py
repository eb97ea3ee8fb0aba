"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of hashed byte trigrams (letters lower-cased,
ASCII non-letters as blanks), scaled to length 1.  Every language has several
centroids, found by spherical k-means inside that language; a text gets the
language of the nearest centroid by cosine.  A text whose cosine lies below a
floor is too far from anything learned and is flagged as rejected.

The floor comes from texts that the centroids were not made from, for each
doubling of the length, as short texts lie farther from every centroid.  Of
such a text two cosines are taken: with the centroids of all languages, and
with those of the other languages only, as if its own had not been learned.
The floor lies halfway between the cosine that rejects ``foreign`` of the latter
and the one that rejects ``own`` of the former; it never lies above the second.
Neighbouring lengths are taken together until they have ``FEW`` of
these texts.  A model of fewer than two languages has no floor.

Fitting reads at most about ``docs_per_lang`` labelled texts of each language,
chosen by a hash of the id (a documented bound), a quarter of them for the
floors; prediction reads every text whole.

Edge cases: null text, and text without a letter, give ``und`` with score 0,
rejected; a model without any language gives the same for every text; null
languages are not learned; repeated rows get equal results; only the text is
an input of a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

DIMENSIONS = 4096
#: lengths are told apart by their doublings, up to 2**(LENGTHS - 1) bytes and beyond
LENGTHS = 24
#: held-out texts that a floor is learned from at least
FEW = 20
#: cosines are counted in steps of 1 / STEPS
STEPS = 1000
RESULT = "struct<lang_pred:string,score:double,rejected:boolean>"

_FOLD = np.arange(256, dtype=np.int64)
_FOLD[:128] = [ord(chr(i).lower()) if chr(i).isalpha() else 32 for i in range(128)]


@dataclass
class Centroids:
    langs: list[str]         # one per centroid
    vectors: np.ndarray      # centroid rows, length 1
    floors: np.ndarray       # least cosine accepted, per doubling of the length
    idf: np.ndarray


def trigram_counts(text: str) -> np.ndarray:
    a = _FOLD[np.frombuffer(f" {text} ".encode(), dtype=np.uint8)]
    code = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
    return np.bincount((code * 2654435761 >> 18) & (DIMENSIONS - 1), minlength=DIMENSIONS)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.empty((len(texts), DIMENSIONS), dtype=np.float32)
    for i, t in enumerate(texts):
        x[i] = np.log1p(trigram_counts(t)) * idf
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.maximum(norms, 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of length 1; starts from the farthest-first rows, so it is deterministic."""
    first = x.mean(axis=0)
    picked, near = [], np.full(len(x), -1.0)
    start = int(np.argmax(x @ first))
    for _ in range(min(k, len(x))):
        picked.append(start)
        near = np.maximum(near, x @ x[start])
        start = int(np.argmin(near))
    c = x[picked]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def length_class(text: str) -> int:
    return min(len(text.encode()).bit_length(), LENGTHS - 1)


def floors_of(counted: list[tuple[int, bool, int, int]], foreign: float, own: float) -> np.ndarray:
    """Floors per length from (length, is_foreign, cosine step, texts)."""
    n = np.zeros((LENGTHS, 2, STEPS + 1), dtype=np.int64)
    for length, is_foreign, step, texts in counted:
        n[length, int(is_foreign), step] += texts
    floors, first, last = np.zeros(LENGTHS), 0, 0.0
    for length in range(LENGTHS):
        mine, others = n[first:length + 1].sum(axis=0).cumsum(axis=1)
        if min(mine[-1], others[-1]) >= FEW:
            # steps below these hold at least that share of the foreign texts, and at most that of the own
            enough = int(np.searchsorted(others, foreign * others[-1])) + 1
            bearable = int(np.searchsorted(mine, own * mine[-1], side="right"))
            last = (min(enough, bearable) + bearable) / (2 * STEPS)
            floors[first:length + 1] = last
            first = length + 1
    floors[first:] = last
    return floors


def fit(df: DataFrame, train: Column, text: str = "text", lang: str = "lang", id_col: str = "doc_id",
        clusters: int = 4, docs_per_lang: int = 1500, foreign: float = 0.95, own: float = 0.005) -> Centroids:
    """Learn centroids from the rows where ``train`` holds."""
    known = small_batches(df).filter(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = known.groupBy(F.col(lang).alias("lang")).count()
    share = (F.lit(docs_per_lang) / F.col("count")).alias("share")
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    aside = (F.pmod(F.xxhash64(F.col(id_col), F.lit("floor")), F.lit(4)) == 0).alias("aside")
    drawn = (known.select(F.col(text).alias("text"), F.col(lang).alias("lang"), chance.alias("chance"), aside)
                  .join(F.broadcast(sizes.select("lang", share)), "lang")  # one row per language
                  .filter("chance < share").select("lang", "text", "aside"))
    sample = drawn.filter(~F.col("aside")).select("lang", "text")

    def document_frequency(batches):
        df_, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for b in batches:
            for t in b["text"]:
                df_ += trigram_counts(t) > 0
            n += len(b)
        yield pd.DataFrame({"bucket": [-1, *np.nonzero(df_)[0]], "n": [n, *df_[df_ > 0]]})

    counted = (sample.mapInPandas(document_frequency, "bucket int, n long")
                     .groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # DIMENSIONS + 1 rows at most
    seen = {r["bucket"]: r["n"] for r in counted}
    total = seen.pop(-1, 0)
    idf = np.full(DIMENSIONS, np.log(1 + total), dtype=np.float32)
    for b, n in seen.items():
        idf[b] = np.log((1 + total) / (1 + n)) + 0.1

    def cluster(key, pdf):
        x = vectors(sorted(pdf["text"]), idf)
        c = spherical_kmeans(x, clusters)
        return pd.DataFrame({"lang": [key[0]] * len(c), "vector": [v.astype(float).tolist() for v in c]})

    rows = (sample.groupBy("lang").applyInPandas(cluster, "lang string, vector array<double>")
                  .collect())  # a few centroids per language
    rows.sort(key=lambda r: (r["lang"], r["vector"]))
    langs = [r["lang"] for r in rows]
    centres = np.array([r["vector"] for r in rows], dtype=np.float32).reshape(len(rows), DIMENSIONS)
    if len(set(langs)) < 2:  # no other language to tell texts from
        return Centroids(langs, centres, np.zeros(LENGTHS), idf)

    def distances(batches):
        of = np.array(langs)
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at:at + 256]
                cos = vectors(list(part["text"]), idf) @ centres.T
                others = np.where(of[None, :] == part["lang"].to_numpy()[:, None], -1, cos)
                both = np.concatenate([cos.max(axis=1), others.max(axis=1)]).clip(0, 1)
                yield pd.DataFrame({"length": [length_class(t) for t in part["text"]] * 2,
                                    "is_foreign": np.repeat([False, True], len(part)),
                                    "step": (both * STEPS).astype(np.int32)})

    held_out = drawn.filter("aside").select("lang", "text").filter(F.col("lang").isin(sorted(set(langs))))
    counted = (held_out.mapInPandas(distances, "length int, is_foreign boolean, step int")
                       .groupBy("length", "is_foreign", "step").count().collect())  # 2 * LENGTHS * (STEPS + 1) rows at most
    return Centroids(langs, centres, floors_of([tuple(r) for r in counted], foreign, own), idf)


def predict(text: Column, model: Centroids) -> Column:
    """Struct column with lang_pred, score (0 to 1) and rejected."""

    def judge(texts: pd.Series) -> pd.DataFrame:
        n = len(texts)
        lang, score, far = np.full(n, "und", dtype=object), np.zeros(n), np.ones(n, dtype=bool)
        usable = [i for i, t in enumerate(texts) if t and model.langs and any(map(str.isalpha, t))]
        for at in range(0, len(usable), 256):
            part = usable[at:at + 256]
            cos = vectors([texts.iloc[i] for i in part], model.idf) @ model.vectors.T
            best = cos.argmax(axis=1)
            top = cos[np.arange(len(part)), best]
            lang[part] = [model.langs[j] for j in best]
            score[part] = np.clip(top, 0, 1)
            far[part] = top < model.floors[[length_class(texts.iloc[i]) for i in part]]
        return pd.DataFrame({"lang_pred": lang, "score": score, "rejected": far})

    return F.pandas_udf(judge, RESULT)(text)
