"""Readers for the landed parquet tables.

Each reader selects only the columns the caller needs so the Parquet scan's
``ReadSchema`` is pruned even before Catalyst sees the rest of the plan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    if name not in TABLES:
        raise KeyError(name)
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def pages(spark, sf_dir, *cols):
    return read_table(spark, sf_dir, "pages", *(cols or ("page_id", "url", "html")))


def documents(spark, sf_dir, *cols):
    return read_table(spark, sf_dir, "documents", *(cols or ("doc_id", "text", "lang")))


def conversations(spark, sf_dir, *cols):
    return read_table(spark, sf_dir, "conversations",
                      *(cols or ("conv_id", "turn", "role", "text")))


def events(spark, sf_dir, *cols):
    return read_table(spark, sf_dir, "events",
                      *(cols or ("event_id", "user_id", "event_type")))
