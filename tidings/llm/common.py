"""Helpers shared by the operators of this package."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: separators of the two word definitions the operators use
SPACES = r"[\x20\x09-\x0D]+"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: ids that a join may broadcast (about 30 MB); beyond, it shuffles
BROADCAST_IDS = 1_000_000


#: rows of an Arrow batch; ten thousand whole texts at once are too much for a worker
ARROW_ROWS = 2000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends Python workers at most ARROW_ROWS rows at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= ARROW_ROWS:
        df.sparkSession.conf.set(name, str(ARROW_ROWS))
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, shared storage on a cluster.

    A cluster must name it, as executors do not see the driver's folders; only
    a local session gets one of its own where the setting is absent (tests).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-stage-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def stage_folder(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a function that writes a table to the shared folder and rereads it; removed at the end."""
    folder = f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    try:
        yield keep
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has."""
    while any(c.startswith(name) for c in df.columns):
        name += "_"
    return name


def with_row_key(df: DataFrame, name: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with a bigint column that tells apart rows of different id or text.

    It is the id where that is not null and all its rows have one text; the
    other rows get numbers beyond all ids, one per id and text.  Ids are
    integers.  ``name`` comes from ``fresh``.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("text"))
    several = rows.groupBy("id").agg(F.min("text").alias("a"), F.max("text").alias("b")).filter("id is null or a <> b")
    top = rows.agg(F.max("id")).first()[0] or 0
    odd = rows.join(several.select(F.col("id").alias("odd")), F.col("id").eqNullSafe(F.col("odd")), "left_semi").distinct()
    odd = stage(odd.select(*[F.col(c).alias(f"{name}{c}") for c in ("id", "text")],
                           (F.monotonically_increasing_id() + F.lit(top + 1).cast("bigint")).alias(f"{name}key")))
    if odd.count() <= BROADCAST_IDS:
        odd = F.broadcast(odd)
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col(f"{name}id")) & (F.xxhash64(text) == F.col(f"{name}text"))
    return df.join(odd, same, "left").select(*df.columns, F.coalesce(f"{name}key", F.col(id_col).cast("bigint")).alias(name))


def without_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose ``key`` is not among the doc_ids of ``ids``; nulls stay."""
    ids = stage(ids.select(F.col("doc_id").alias(key)).distinct())
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_anti").select(*df.columns)


def to_arrays(df: DataFrame) -> dict[str, np.ndarray]:
    """Columns of a table of bounded size as numpy arrays, by Arrow."""
    table = df.toArrow()
    return {name: table[name].to_numpy() for name in table.column_names}


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays.

    ``lower`` does the same, several times faster, for text that is all ASCII.
    """
    is_ascii = F.octet_length(c) == F.char_length(c)
    return F.when(is_ascii, F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column, separators: str) -> Column:
    """Words of a text as an array; null and empty text give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def id_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; null ids fold as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def kth_largest(keys: DataFrame, key: str, k: int, bins: int = 4096, few: int = 10_000) -> float | None:
    """The k-th largest value of a double column, exactly.

    Counts per value range; the range that holds the k-th value is counted
    again in finer ranges until it holds ``few`` rows or a single value.
    """
    rows = keys.select(F.col(key).alias("x"))
    low, high, n = rows.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if k <= 0 or n == 0:
        return None
    if k >= n:
        return low
    while low < high and n > few:
        spot = F.least(F.floor((F.col("x") - low) / F.lit(high - low) * bins), F.lit(bins - 1))
        parts = (rows.groupBy(spot.alias("spot")).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
                     .orderBy(F.desc("spot")).collect())  # ``bins`` rows at most
        for p in parts:
            if k <= p["n"]:
                break
            k -= p["n"]
        low, high, n = p["low"], p["high"], p["n"]
        rows = rows.filter(F.col("x").between(low, high))
    if low == high:
        return low
    return sorted((r["x"] for r in rows.collect()), reverse=True)[k - 1]  # ``few`` rows at most
