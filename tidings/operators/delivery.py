"""O31 — what became of every outbox row: a log of sending attempts.

The reference posts a message and maps the answer to sent or failed.  Here the
sender lands its answers, and the log keeps one row per message and attempt:
attempt 0 is the outbox row itself (ready, error, rejected or
needs_translation), later ones are sent or failed.  The log only grows; the
last state of a message is a fold over its rows that does not depend on their
order or number, so a batch appended twice changes nothing.

Layout: ``…/run_date=D/batch=B``.  A batch is written by one job under its own
name, so a killed writer leaves no rows and its rerun replaces its own.
``compact`` folds a day to one row per message, writes that as a batch, and
then removes the batches it read: killed before, between or after, the fold of
what can be read is the same.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.operators.outbox import READY

SENT, FAILED = "sent", "failed"
LOG_SCHEMA = "message_id string, channel string, attempt int, state string, detail string"

# The reference's error texts of a failed send, by channel.
TEXT_SEND_FAILED = {"push": "LINE API error: ", "broadcast": "LINE broadcast error: ", "reply": "LINE reply error: "}
TEXT_NO_BODY = "Unknown error"
TEXT_NO_ANSWER = "Network error"


def message_id(job: str, *keys: str) -> Column:
    """"{job}:{key}:…": the name of an outbox row across runs."""
    return F.concat_ws(":", F.lit(job), *[F.col(k).cast("string") for k in keys])


def first_states(outbox: DataFrame) -> DataFrame:
    """Attempt 0 of outbox rows (message_id, channel, status, error_text; without a status they are ready)."""
    state = F.col("status") if "status" in outbox.columns else F.lit(READY)
    detail = F.col("error_text") if "error_text" in outbox.columns else F.lit(None).cast("string")
    return outbox.select("message_id", "channel", F.lit(0).alias("attempt"), state.alias("state"), detail.alias("detail"))


def attempts(due_rows: DataFrame, answers: DataFrame) -> DataFrame:
    """The next attempt of the due rows that have an answer (message_id,
    http_status, body): 2xx is sent, anything else failed with the channel's
    text; a null status is a send without an answer."""
    prefix = F.coalesce(*[F.when(F.col("channel") == c, text) for c, text in TEXT_SEND_FAILED.items()])
    sent = F.coalesce(F.col("http_status").between(200, 299), F.lit(False))
    detail = (F.when(F.col("http_status").isNull(), TEXT_NO_ANSWER)
               .when(~sent, F.concat(prefix, F.coalesce("body", F.lit(TEXT_NO_BODY)))))
    return due_rows.join(answers.select("message_id", "http_status", "body"), "message_id").select(
        "message_id", "channel", (F.col("attempt") + 1).alias("attempt"),
        F.when(sent, SENT).otherwise(FAILED).alias("state"), detail.alias("detail"))


def append(rows: DataFrame, path: str, run_date: str, batch: str) -> None:
    """Add a batch of log rows; the same batch again replaces itself."""
    rows.select(*[f.split()[0] for f in LOG_SCHEMA.split(", ")]).write.mode("overwrite").parquet(f"{path}/run_date={run_date}/batch={batch}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the log with their ``run_date`` and ``batch``."""
    return spark.read.schema(f"{LOG_SCHEMA}, run_date string, batch string").parquet(path)


def last_states(log: DataFrame) -> DataFrame:
    """(run_date, message_id, channel, attempt, state, detail): the last attempt
    of each message; of two records of one attempt, sent wins."""
    last = F.max(F.struct("attempt", (F.col("state") == SENT).alias("done"), "state", "detail", "channel"))
    return (log.groupBy("run_date", "message_id").agg(last.alias("l"))
               .select("run_date", "message_id", "l.channel", "l.attempt", "l.state", "l.detail"))


def due(states: DataFrame, max_attempts: int) -> DataFrame:
    """Messages to send now: ready ones, and failed ones with attempts left."""
    return states.where(F.col("state").isin(READY, FAILED) & (F.col("attempt") < max_attempts))


def compact(spark: SparkSession, path: str, run_date: str) -> None:
    """Fold the log of a day to one row per message."""
    day = read_log(spark, path).where(F.col("run_date") == run_date)
    old = [r["batch"] for r in day.select("batch").distinct().collect()]  # one name per append
    append(last_states(day), path, run_date, f"compacted-{uuid.uuid4().hex}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for batch in old:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/run_date={run_date}/batch={batch}")
        folder.getFileSystem(conf).delete(folder, True)
