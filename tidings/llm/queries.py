"""Registered queries of this package: operator, production parameters, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, jaccard, language, line_rules, merkle, negatives, packing, ppm, resample, secret_scan,
               sharding, substring, urls)
from .common import ascii_lower, id_fold, read_table
from .twins import SQL  # noqa: F401  the entry module reads it from here

SHARDS = 40
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(read_table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: labelled good and not toxic; sample size: the share of rows labelled good."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    share = labels.agg(F.avg("quality")).first()[0]
    k = round(docs.count() * (1.0 if share is None else share))
    return resample.resample(docs, labels.filter("quality = 1 and toxic = 0").select("doc_id"), k)


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled URLs are those that a rule decides; the trees judge the others."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    _, decided = urls.longest_rule(urls.host(F.col("url")), urls.path(F.col("url")), RULES)
    labelled = pages.select("url", decided.alias("d")).filter("d is not null").select("url", (F.col("d") == "block").alias("label"))
    return urls.judge_urls(pages, labelled, RULES).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secrets.spans")
    base = F.filter(spans, lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", "secrets.n_assign", "secrets.n_access", "secrets.n_hex",
                        F.sha2(secret_scan.span_list(base).cast("binary"), 256).alias("base_sha256"),
                        secret_scan.span_list(spans).alias("spans"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(read_table(spark, sf_dir, "documents"), id_fold(F.col("doc_id"), 7) != 2)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = id_fold(F.col("doc_id"), 4) == 2
    model = language.fit(docs, ~held_out)
    return (docs.select("doc_id", held_out.alias("held_out"), language.predict(F.col("text"), model).alias("p"))
                .select("doc_id", "held_out", "p.*"))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.line_first(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "rules.*").drop("clean_text")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 3 divides the id's crc32 the text is tampered with; a null id has no crc32."""
    docs = read_table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    claimed = F.when(tampered, merkle.leaf_digest(*[F.col(f) for f in fields[:-1]], ascii_lower(F.col("text"))))
    proofs = merkle.manifest(docs, fields, "lang", "doc_id", [F.col("doc_id"), claimed.alias("claimed")])
    folded = merkle.fold(F.coalesce("carried.claimed", "leaf"), F.col("path"))
    found = proofs.select("carried.doc_id", *[merkle.as_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
                          merkle.proof_digest(F.col("path")).alias("proof_sha256"),
                          merkle.as_hex(folded).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id 7 divides get a wrong label first; anchors are the ids that 100 divides."""
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_sharding": op2_sharding,
    "op3_resample": op3_resample,
    "op4_urls": op4_urls,
    "op5_secrets": op5_secrets,
    "op6_packing": op6_packing,
    "op7_ppm": op7_ppm,
    "op8_jaccard": op8_jaccard,
    "op9_language": op9_language,
    "op10_line_rules": op10_line_rules,
    "op11_merkle": op11_merkle,
    "op12_negatives": op12_negatives,
    "op13_substring": op13_substring,
}
