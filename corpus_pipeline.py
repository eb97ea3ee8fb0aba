"""The corpus pipeline: documents in, packed training sequences out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame.  Every stage works on all rows the one before kept,
and all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm import decontaminate, jaccard, language, packing, secret_scan
from tidings.llm.common import fresh, id_fold, read_table, small_batches, stage, stage_folder, with_row_key, without_ids


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents too far from every learned language, or without a letter."""
    model = language.fit(docs, id_fold(F.col("doc_id"), 4) != 2)
    kept = docs.withColumn("_language", language.predict(F.col("text"), model)).filter(~F.col("_language.rejected"))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, that of the smallest id.

    Rows are judged by id and text: an id on several texts loses only the
    copies among them, null ids are judged like others (they come last), and
    of rows equal in both one stays.
    """
    key = fresh(docs, "_row")
    rows = with_row_key(docs, key)
    found = jaccard.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"))
    kept = without_ids(rows, found.filter("component_id <> doc_id").select("doc_id"), key)
    repeated = stage(found.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(repeated.withColumnRenamed("doc_id", key), key, "left_semi").dropDuplicates([key])
    return without_ids(kept, repeated, key).unionByName(once).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a span of the benchmark, judged by id and text; null ids too."""
    key = fresh(docs, "_row")
    rows = with_row_key(docs, key)
    found = decontaminate.contamination(rows.select(F.col(key).alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    return without_ids(rows, found.filter("n_hit > 0").select("doc_id"), key).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the text by a mark; no document is dropped."""
    masked = small_batches(docs).withColumn("text", secret_scan.redacted(F.col("text")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the learned stage nor the tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and reread."""
    docs = read_table(spark, sf_dir, "documents")
    with stage_folder(spark) as keep:
        for i, (_, step) in enumerate(STAGES[:-1]):
            docs = keep(step(spark, docs, sf_dir), str(i))
        return STAGES[-1][1](spark, docs, sf_dir)
