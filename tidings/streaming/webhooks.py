"""O42 — webhook events as a Structured Streaming job.

The reference acknowledges a webhook at once, asks the model later, and
answers when the reply is there.  Here landed webhook files and landed reply
files are two streams.  Events pass the stateless part (signature, strict
parse, first-event outcome); accepted ones then wait in the state store for
their reply, a left outer join of the two streams on the webhook's id:

* a reply may land before or after its event, up to ``patience`` apart;
* an event whose reply has not landed by then leaves the state once, without a
  reply, and its route is ``model_error``; a reply after that is dropped;
* events that are not accepted have no reply to wait for and pass at once.

Time is the landing time of a row (``landed_at``), and the watermark follows
the slower stream by ``lateness``.  So time stands still while one stream lands
nothing; ``heartbeat`` rows, which belong to no webhook, carry it on.

``foreachBatch`` gives each micro-batch the same language guess, routing and
four kinds of answers as the batch job.  The tables that it joins are landed in
buckets of their key; a micro-batch reads only the buckets its own keys fall
in.  Output goes to ``…/batch_id=N`` with overwrite, so a replayed batch
replaces its own rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidings.functions.text import language_terms
from tidings.operators import enrich as J3
from tidings.operators import webhooks as J5

WEBHOOK_SCHEMA = "webhook_id string, feed_id bigint, signature string, body binary, landed_at timestamp"
REPLY_SCHEMA = "key string, http_status int, body string, landed_at timestamp"
PATIENCE, LATENESS = "1 hour", "2 hours"
#: id of rows that only carry the time on
HEARTBEAT = ""
#: folders of a landed table; a micro-batch reads those its keys fall in
BUCKETS = 64
#: landed tables and the key each is cut by
KEYS = {"profiles": "word", "headlines": "feed_id", "feeds": "feed_id", "extracts": "url", "results": "webhook_id",
        "url_results": "url", "translations": "webhook_id"}


def bucket(key) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


@dataclass
class Landed:
    """Tables the stream joins, landed once by bucket of their key; see KEYS."""
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def cut(self, name: str, buckets: list[int]) -> DataFrame | None:
        """Rows of the named table in ``buckets``: other folders are not read."""
        if name not in self.tables:
            return None
        return self.tables[name].where(F.col("bucket").isin(buckets)).drop("bucket")


def land(spark: SparkSession, path: str, **tables: DataFrame | None) -> Landed:
    """Write each table below ``path``, one folder per bucket of its key, and reread it."""
    landed = Landed()
    for name, df in tables.items():
        if df is not None:
            (df.withColumn("bucket", bucket(KEYS[name])).repartition("bucket")
               .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}"))
            schema = StructType([*df.schema.fields, StructField("bucket", IntegerType())])  # the table may be empty
            landed.tables[name] = spark.read.schema(schema).parquet(f"{path}/{name}")
    return landed


def _buckets(**keys: DataFrame) -> dict[str, list[int]]:
    """The buckets that the keys of each one-column table fall in, in one job; BUCKETS numbers each at most."""
    if not keys:
        return {}
    each = [df.select(F.lit(name).alias("name"), bucket(df.columns[0]).alias("bucket")).distinct() for name, df in keys.items()]
    found: dict[str, list[int]] = {name: [] for name in keys}
    every = each[0]
    for df in each[1:]:
        every = every.unionByName(df)
    for name, number in every.collect():
        found[name].append(number)
    return found


def heartbeat(spark: SparkSession, at: datetime, webhooks_path: str, replies_path: str) -> None:
    """Land a row in both streams that belongs to no webhook and says that it is ``at``."""
    spark.createDataFrame([(HEARTBEAT, None, None, None, at)], WEBHOOK_SCHEMA).write.mode("append").parquet(webhooks_path)
    spark.createDataFrame([(HEARTBEAT, None, None, at)], REPLY_SCHEMA).write.mode("append").parquet(replies_path)


def answered_events(webhooks: DataFrame, replies: DataFrame, secret: str, patience: str = PATIENCE,
                    lateness: str = LATENESS) -> DataFrame:
    """First-event outcomes (streams of WEBHOOK_SCHEMA and REPLY_SCHEMA) with the decoded reply, or without one."""
    events = J5.first_event_outcome(webhooks.withWatermark("landed_at", lateness), secret, ("landed_at",)).alias("e")
    calls = (J5.decode_tool_calls(replies.withWatermark("landed_at", lateness), ("landed_at",))
               .withColumnRenamed("landed_at", "replied_at").alias("r"))
    wait = F.expr(f"INTERVAL {patience}")
    # an event that is not accepted fails the condition on its own side, so it is never stored
    meet = ((F.col("e.outcome") == "accepted") & (F.col("e.webhook_id") == F.col("r.key"))
            & (F.col("r.replied_at") >= F.col("e.landed_at") - wait) & (F.col("r.replied_at") <= F.col("e.landed_at") + wait))
    return events.join(calls, meet, "leftOuter").select("e.*", "r.status", "r.name", "r.arguments", "r.message")


def route_batch(events: DataFrame, landed: Landed) -> DataFrame:
    """Language and route of one batch of answered events."""
    words = events.select(F.explode(language_terms("text")).alias("word"))
    profiles = landed.cut("profiles", _buckets(words=words)["words"])
    return J5.routes_of(J3.with_language(events, profiles))


def answer_batch(routes: DataFrame, landed: Landed, run_date: str) -> DataFrame:
    """Outbox rows of one batch's routes."""
    from tidings.plans.jobs import all_outbox

    routed = routes.where(F.col("outcome") == "routed")
    wanted = _buckets(feed_id=routed.select("feed_id"), webhook_id=routed.select("webhook_id"),
                      url=J5.call_urls(routes).select("url"))
    cut = {name: landed.cut(name, wanted[key]) for name, key in KEYS.items() if key in wanted}
    return all_outbox(routes, cut["headlines"], cut["feeds"], cut["extracts"], run_date, cut["results"], cut["url_results"],
                      cut["translations"])


def start_webhook_stream(spark: SparkSession, webhooks_path: str, replies_path: str, landed: Landed, secret: str, run_date: str,
                         sink_path: str, outbox_path: str, checkpoint_path: str, available_now: bool = True,
                         max_files_per_trigger: int = 1000, patience: str = PATIENCE, lateness: str = LATENESS):
    """Start the stream; returns the StreamingQuery.

    Routes go to ``sink_path/batch_id=N``, the answers of all four routes to
    ``outbox_path/batch_id=N``, the answered events between the two to the
    checkpoint's folder.
    """
    def landing(schema: str, path: str) -> DataFrame:
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(max_files_per_trigger)).parquet(path)

    events = answered_events(landing(WEBHOOK_SCHEMA, webhooks_path), landing(REPLY_SCHEMA, replies_path), secret, patience, lateness)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # written once: the join's state must not be run through again for every use
        held, path = f"{checkpoint_path}-events/batch_id={batch_id}", f"{sink_path}/batch_id={batch_id}"
        batch.where(F.col("webhook_id") != HEARTBEAT).write.mode("overwrite").parquet(held)
        route_batch(spark.read.parquet(held), landed).write.mode("overwrite").parquet(path)
        routes = spark.read.parquet(path)
        answer_batch(routes, landed, run_date).write.mode("overwrite").parquet(f"{outbox_path}/batch_id={batch_id}")

    w = events.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_path)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_sink(spark: SparkSession, sink_path: str) -> DataFrame:
    return spark.read.parquet(sink_path)
