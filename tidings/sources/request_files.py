"""O14, O15, O36 — request bodies as files for the model service.

One line per request, ``{"key":…,"body":{…}}``, in
``…/run=R/task=T/file=N``.  A file holds at most ``max_bytes`` (a single longer
line is a file of its own), so a sender can take files one by one.  Requests
are numbered into files by the running sum of their bytes inside hash groups of
a task, whose number follows the bytes, so no task of the job orders more than
``GROUP_FILES`` files' worth of lines.

A run writes only requests that have no answer yet: ``answered`` names the keys
of landed replies.  The run's name makes a repeated run replace its own files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidings.session import materialize

MAX_BYTES = 64 << 20
GROUP_FILES = 16


def request_line(key: str = "key", body: str = "body"):
    """The request as one line of JSON; the body is JSON text already."""
    quoted = F.regexp_extract(F.to_json(F.array(key)), r"(?s)^\[(.*)\]$", 1)
    return F.concat(F.lit('{"key":'), quoted, F.lit(',"body":'), F.col(body), F.lit("}"))


def pending(requests: DataFrame, answered: DataFrame | None) -> DataFrame:
    """Requests (task, key, body) whose key has no answer."""
    rows = requests.select("task", "key", "body")
    return rows if answered is None else rows.join(answered.select("key"), "key", "left_anti")


def numbered_files(requests: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(task, file, line) of requests: the file each line goes to.

    A line goes to the file in whose half of ``max_bytes`` it starts, and lines
    above that half are files of their own, so no file of several lines passes
    ``max_bytes``.
    """
    lines = requests.select("task", "key", request_line().alias("line"))
    lines = lines.withColumn("size", F.octet_length("line") + 1)
    half = max(max_bytes // 2, 1)
    total = lines.agg(F.sum("size")).first()[0] or 0
    groups = total // (GROUP_FILES * half) + 1
    lines = lines.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))
    before = Window.partitionBy("task", "group").orderBy("long", "key", "line").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(before), F.lit(0))
    # long lines come last, each with a number of its own
    each = F.sum(F.col("long").cast("int")).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = lines.withColumn("long", F.col("size") > half).select(
        "task", "line", F.concat_ws("-", F.col("group").cast("string"), F.when(F.col("long"), F.concat(F.lit("long"), each.cast("string")))
                                    .otherwise(F.floor(start / half).cast("string"))).alias("file"))
    return placed


def write_requests(requests: DataFrame, path: str, run: str, answered: DataFrame | None = None,
                   max_bytes: int = MAX_BYTES) -> None:
    """Write the unanswered requests (task, key, body) of one run."""
    # read for the sum of their bytes and for the files
    files = numbered_files(materialize(pending(requests, answered)), max_bytes)
    (files.repartition("task", "file").select("task", "file", F.col("line").alias("value"))
          .write.mode("overwrite").partitionBy("task", "file").text(f"{path}/run={run}"))


def read_requests(spark: SparkSession, path: str, run: str) -> DataFrame:
    """(task, file, key, body) of a run's files."""
    lines = spark.read.schema("value string, task string, file string").text(f"{path}/run={run}")
    body = F.regexp_extract("value", r'(?s)^\{"key":"(?:[^"\\]|\\.)*+","body":(.*)\}$', 1)
    return lines.select("task", "file", F.get_json_object("value", "$.key").alias("key"), body.alias("body"))
