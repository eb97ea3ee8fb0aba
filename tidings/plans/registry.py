"""Query registry: key -> callable(spark, sf_dir) -> DataFrame.

Inputs are read from the landed tables (or derived from them by Spark with
the rules in ``tidings.sources``), so every query's work grows with the data.
"""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from tidings.operators import delivery as LOG
from tidings.operators import digests as J2
from tidings.operators import enrich as J3
from tidings.operators import feeds as J1
from tidings.operators import outbox as J4
from tidings.operators import webhooks as J5
from tidings.plans import jobs as JOBS
from tidings.session import dealt, materialize, sub_dir
from tidings.sources import feeds as FEEDS
from tidings.sources import fixtures as FX
from tidings.sources import request_files as FILES
from tidings.sources import tables as T
from tidings.streaming import webhooks as STREAM

QUERIES: dict = {}
FLAGSHIP = "job_story_broadcast"
RUN_DATE = "2024-01-31"  # card date: a job parameter, fixed for repeatable output
SECRET = FX.FIXTURE_SECRET
CHAT_MODEL = "gpt-4o"  # fixed value: the reference's chat model name


def register(key):
    def deco(fn):
        QUERIES[key] = fn
        return fn
    return deco


def _feeds(spark, d):
    return FX.landed_feeds(T.pages(spark, d))


def _stories(spark, d):
    """Story rows of every page."""
    return J1.page_stories(T.pages(spark, d, "page_id", "html"))


def _arrays(spark, d):
    """The same stories, one array per page."""
    return J1.page_story_arrays(T.pages(spark, d, "page_id", "html"))


def _selections(spark, d):
    return FX.selections(T.events(spark, d))


# J1 ---------------------------------------------------------------------------
register("feed_items")(lambda s, d: J1.feed_items(_feeds(s, d)))
register("latest_item")(lambda s, d: J1.latest_item(_feeds(s, d)))
register("extract_links")(lambda s, d: J1.extract_links(T.pages(s, d, "page_id", "html")))
register("latest_stories")(lambda s, d: J1.latest_stories(_feeds(s, d)))
register("feed_status")(lambda s, d: J1.feed_status(_feeds(s, d)))
register("latest_title")(lambda s, d: J1.latest_title(_feeds(s, d)))


def _landed_feed_items(spark, d):
    """The feeds landed as files, one per feed, and read item by item; feeds without an answer left no file."""
    path = sub_dir(spark, f"feed_files/{uuid.uuid4().hex}")
    feeds = FX.landed_feeds(dealt(T.pages(spark, d), "page_id"))
    FEEDS.land_feed_files(feeds, path)
    return FEEDS.landed_items(spark, path, feeds.select("feed_id", "http_status"), FEEDS.landed_id())


register("landed_feed_items")(_landed_feed_items)


# J2 ---------------------------------------------------------------------------
register("story_rank")(lambda s, d: J2.story_rank(_stories(s, d)))
register("story_digest")(lambda s, d: J2.story_digest(_arrays(s, d)))
register("select_stories")(lambda s, d: J2.select_stories(_selections(s, d), _arrays(s, d)))
register("selection_status")(lambda s, d: J2.selection_status(_selections(s, d), _arrays(s, d)))
register("latest_headline")(lambda s, d: J2.feed_headlines(_feeds(s, d)))
register("valid_urls")(lambda s, d: J2.valid_urls(FX.urls(T.pages(s, d, "page_id", "url"))))
register("translate_queue")(lambda s, d: J2.translate_queue(_selections(s, d))
                            .select("request_id", "user_id", "language_code"))


# J3 / J4 ------------------------------------------------------------------------
def _story_results(stories):
    """Landed story summaries that parsed: (feed_id, rank, summary)."""
    replies = J3.inference_results(FX.story_replies(stories), ("feed_id", "rank"))
    return replies.select("feed_id", "rank", F.col("content").alias("summary"))


def _digest_results(spark, d):
    return J3.inference_results(FX.digest_replies(T.pages(spark, d, "page_id")), ("feed_id",))


def _selection_replies(spark, d):
    return FX.selection_replies(T.conversations(spark, d))


def _url_replies(spark, d):
    return FX.url_replies(T.pages(spark, d))


def _highlights(spark, d):
    return J3.digest_highlights(_arrays(spark, d))


register("story_extract")(lambda s, d: J3.extract_summary(T.documents(s, d, "doc_id", "text"), ["doc_id"], "text"))
register("enrich_with_default")(lambda s, d: J3.enrich_with_default(_stories(s, d), _story_results(_stories(s, d))))
register("digest_highlights")(_highlights)
register("truncate_text")(lambda s, d: J4.truncate_text(
    T.conversations(s, d, "conv_id", "turn", "text"), "text", ["conv_id", "turn"]))
register("text_messages")(lambda s, d: J4.text_messages(T.conversations(s, d), "text", ["conv_id", "turn"]))
register("story_carousel")(lambda s, d: J4.story_carousel(
    _arrays(s, d).select("feed_id", J3.story_summaries(F.col("stories")).alias("stories")))
    .select("feed_id", "n_bubbles", F.to_json("message").alias("payload")))
register("summary_sections")(lambda s, d: J4.summary_sections(J2.story_digest(_arrays(s, d)), "digest", ["feed_id"]))
register("summary_bubble")(lambda s, d: J4.summary_bubbles(
    _highlights(s, d), "highlight", ["feed_id"], RUN_DATE)
    .select("feed_id", F.to_json("message").alias("payload")))
register("outbox_broadcast")(lambda s, d: J4.outbox_broadcast(
    J4.summary_bubbles(_highlights(s, d), "highlight", ["feed_id"], RUN_DATE), keys=["feed_id"]))


# J5 ---------------------------------------------------------------------------
def _webhooks(spark, d):
    return FX.webhooks(T.conversations(spark, d))


def _outcomes(spark, d):
    return J5.first_event_outcome(_webhooks(spark, d), SECRET)


def _replies(spark, d):
    return FX.tool_replies(T.conversations(spark, d), T.pages(spark, d, "page_id", "url"))


def _calls(spark, d):
    return J5.decode_tool_calls(_replies(spark, d))


def _routes(spark, d):
    return J5.route_calls(_outcomes(spark, d), _calls(spark, d))


register("verify_signatures")(lambda s, d: J5.verify_signatures(_webhooks(s, d), SECRET)
                              .select("webhook_id", "signature_ok"))
register("parse_webhooks")(lambda s, d: J5.parse_webhooks(J5.verify_signatures(_webhooks(s, d), SECRET))
                           .select("webhook_id", "signature_ok", "parse_ok",
                                   F.coalesce(F.size("events"), F.lit(0)).cast("bigint").alias("n_events")))
register("first_event_outcome")(_outcomes)
register("decode_tool_calls")(_calls)
register("tool_requests")(lambda s, d: J5.tool_requests(
    T.conversations(s, d).where(F.col("role") == "user"), "text", ["conv_id", "turn"], CHAT_MODEL))
register("route_calls")(lambda s, d: _routes(s, d).select("webhook_id", "route", "outcome",
                                                          "reply_token", "user_id"))
register("call_indexes")(lambda s, d: J5.call_indexes(_routes(s, d)))
register("call_urls")(lambda s, d: J5.call_urls(_routes(s, d)))
register("conversation_replies")(lambda s, d: J5.conversation_replies(
    FX.conversation_requests(T.conversations(s, d)), _calls(s, d)))
register("webhook_funnel")(lambda s, d: J5.webhook_funnel(_routes(s, d)))


# J3 (rest) --------------------------------------------------------------------------
def _request_rows(spark, d, arrays):
    """Every prompted request the flows make, as (key, task, content); ``arrays`` is read by two of them."""
    digest = J2.digest_text(F.col("stories"))
    # one pass over the pages gives a feed's story requests and its digest request
    per_story = F.transform("stories", lambda s, i: F.struct(
        F.concat(F.lit("story:"), F.col("feed_id").cast("string"), F.lit(":"), (i + 1).cast("string")).alias("key"),
        F.lit("summary_single").alias("task"), s["story"].alias("content")))
    per_feed = F.array(F.struct(F.concat(F.lit("digest:"), F.col("feed_id").cast("string")).alias("key"),
                                F.lit("summary_all").alias("task"), digest.alias("content")))
    both = arrays.select(F.inline(F.concat(per_story, F.slice(per_feed, 1, F.when(F.size("stories") > 0, 1).otherwise(0)))))
    conv = T.conversations(spark, d).where(F.col("role") == "user")
    lang = conv.select(F.concat(F.lit("lang:"), FX.request_key()).alias("key"), F.lit("get_language_code").alias("task"),
                       F.col("text").alias("content"))
    sel = J2.translate_queue(J2.select_stories(_selections(spark, d), arrays))
    tr = sel.select(F.concat(F.lit("translate:"), F.col("request_id").cast("string")).alias("key"),
                    F.lit("translate").alias("task"),
                    J3.translate_content("language_code", "digest").alias("content"))
    return both.unionByName(lang).unionByName(tr)


def _detect_docs(spark, d):
    """Each half of the documents (even, odd ids) is labelled by words learned from the other."""
    half = (F.col("doc_id") % 2).alias("half")
    docs = FX.language_documents(T.documents(spark, d, "doc_id", "text", "lang"))
    learned = J3.language_profiles(docs.select(half, "text", "lang"), by=["half"])
    profiles = materialize(learned.select((1 - F.col("half")).alias("half"), "word", "lang"))
    return (J3.detect_language(docs.select("doc_id", half, "text", "lang"), profiles, ["doc_id", "lang"], by=["half"])
              .select("doc_id", "language", "lang"))


register("inference_requests")(lambda s, d: J3.inference_requests(
    _request_rows(s, d, materialize(_arrays(s, d))), J3.tasks_table(s)))
register("url_summary_requests")(lambda s, d: J3.url_summary_requests(FX.urls(T.pages(s, d, "page_id", "url"))))
register("inference_results")(lambda s, d: J3.inference_results(
    FX.inference_replies(T.documents(s, d, "doc_id", "text"))))
register("url_summary_results")(lambda s, d: J3.url_summary_results(FX.url_replies(T.pages(s, d))))
register("detect_language")(_detect_docs)
register("page_extract")(lambda s, d: J3.page_extract(T.pages(s, d, "page_id", "html")))


# Outbox and end-to-end jobs ---------------------------------------------------------
def _profiles(spark, d):
    """Word profile of all documents, landed once per job."""
    return materialize(J3.language_profiles(T.documents(spark, d, "text", "lang")))


def _webhook_routes(spark, d):
    # the push jobs read the routes twice: for the keys they need, and for the answers
    return materialize(JOBS.webhook_routes(_webhooks(spark, d), _replies(spark, d), SECRET, _profiles(spark, d)))


def _landed(spark, d):
    """Replies and translations that have landed for the webhook flows."""
    return {"selection_replies": _selection_replies(spark, d), "url_replies": _url_replies(spark, d),
            "translations": FX.translations(T.conversations(spark, d))}


def _outbox_push(spark, d):
    sel = J2.select_stories(_selections(spark, d), _arrays(spark, d))
    msgs = sel.select("request_id", "user_id",
                      J4.summary_bubble(F.col("digest"), RUN_DATE).alias("message"))
    return J4.outbox_push(msgs, keys=["request_id"])


def _outbox_reply(spark, d):
    routes = materialize(_routes(spark, d))  # read for the wanted pages and for the answers
    pages = JOBS.asked_pages(T.pages(spark, d), routes, "reply_latest_story")
    out = JOBS.webhook_outbox(routes, JOBS.page_headlines(pages))
    return out.where(F.col("channel") == "reply").drop("request_text")


def _job_webhooks(spark, d):
    return JOBS.process_webhooks(_webhooks(spark, d), _replies(spark, d), SECRET, _profiles(spark, d),
                                 T.pages(spark, d), RUN_DATE, **_landed(spark, d))


def _job_push_summaries(spark, d):
    routes = _webhook_routes(spark, d)
    pages = JOBS.asked_pages(T.pages(spark, d, "page_id", "html"), routes, "push_summary")
    results = JOBS.landed_selection_results(_selection_replies(spark, d), routes)
    return JOBS.push_summaries(routes, J1.page_story_arrays(pages), RUN_DATE, results, FX.translations(T.conversations(spark, d)))


def _job_story_broadcast(spark, d):
    # the links of a page are found once, for the feed's older items and for the replies
    pages = materialize(J1.with_story_arrays(T.pages(spark, d)))
    stories = J1.stories_of(pages.select(F.col("page_id").alias("feed_id"), "stories"))
    return JOBS.story_broadcast(FX.landed_feeds(pages, F.col("stories")), _story_results(stories))


def _job_push_url(spark, d):
    routes = _webhook_routes(spark, d)
    results = JOBS.landed_url_results(_url_replies(spark, d), J5.call_urls(routes))
    return JOBS.push_url(routes, T.pages(spark, d), RUN_DATE, results, FX.translations(T.conversations(spark, d)))


register("outbox_push")(_outbox_push)
register("outbox_reply")(_outbox_reply)
register("job_story_broadcast")(_job_story_broadcast)
register("job_daily_summary")(lambda s, d: JOBS.daily_summary(_feeds(s, d), RUN_DATE, _digest_results(s, d)))
register("job_push_summaries")(_job_push_summaries)
register("job_push_url")(_job_push_url)
register("job_webhooks")(_job_webhooks)


# Sinks and streaming ----------------------------------------------------------------
def _outbox_sink(spark, d):
    """Three jobs' rows written to the durable outbox of this run, read back."""
    path = sub_dir(spark, f"outbox/{uuid.uuid4().hex}")
    cards = J4.summary_bubbles(_highlights(spark, d), "highlight", ["feed_id"], RUN_DATE)
    J4.outbox_sink(J4.outbox_broadcast(cards), path, "daily_summary", RUN_DATE)
    J4.outbox_sink(_outbox_push(spark, d).drop("request_id"), path, "push_summaries", RUN_DATE)
    J4.outbox_sink(_outbox_reply(spark, d).select("channel", "recipient", "payload", "status"), path, "webhooks", RUN_DATE)
    return spark.read.parquet(path).withColumn("run_date", F.col("run_date").cast("string"))


def stream_tables(spark, d, path):
    """The tables that the webhook stream joins, landed below ``path``."""
    pages, replied = T.pages(spark, d), _landed(spark, d)
    return STREAM.land(spark, path, profiles=J3.language_profiles(T.documents(spark, d, "text", "lang")),
                       headlines=JOBS.page_headlines(pages), feeds=J1.page_story_arrays(pages),
                       extracts=JOBS.page_summaries(pages), results=J3.inference_results(replied["selection_replies"], ("webhook_id",)),
                       translations=replied["translations"],
                       url_results=JOBS.landed_url_results(replied["url_replies"]))


def stream_run(spark, d, max_files_per_trigger: int = 1000, files: int | None = None) -> str:
    """Land webhooks and replies, run the stream to completion; the folder of its outputs.

    Replies land up to 40 minutes after their webhooks; a heartbeat a day later ends all waiting.
    """
    run = sub_dir(spark, f"webhook_stream/{uuid.uuid4().hex}")
    for name, rows in (("in", FX.landed_webhooks(_webhooks(spark, d))), ("replies", FX.landed_replies(_replies(spark, d)))):
        (rows.repartition(files) if files else rows).write.mode("overwrite").parquet(f"{run}/{name}")
    landed = stream_tables(spark, d, f"{run}/landed")

    def go():
        STREAM.start_webhook_stream(spark, f"{run}/in", f"{run}/replies", landed, SECRET, RUN_DATE, f"{run}/sink", f"{run}/outbox",
                                    f"{run}/checkpoint", max_files_per_trigger=max_files_per_trigger).awaitTermination()
    go()
    STREAM.heartbeat(spark, FX.LANDING_START + timedelta(days=1), f"{run}/in", f"{run}/replies")
    go()
    return run


def _webhook_stream(spark, d):
    """Routes and answers of the streamed webhooks, the columns of ``job_webhooks``."""
    run = stream_run(spark, d)
    routes = STREAM.read_sink(spark, f"{run}/sink").select("webhook_id", "route", "outcome", "language")
    return routes.join(spark.read.parquet(f"{run}/outbox").drop("batch_id"), "webhook_id", "left")


MAX_ATTEMPTS = 3


def _outbox_outcomes(spark, d):
    """Last state of every pushed selection: the outbox rows are logged as ready, sent up to
    MAX_ATTEMPTS times with the landed answers, and the log is compacted after each round."""
    path = sub_dir(spark, f"outbox_log/{uuid.uuid4().hex}")
    rows = _outbox_push(spark, d).withColumn("message_id", LOG.message_id("push_summaries", "request_id"))
    LOG.append(LOG.first_states(rows), path, RUN_DATE, "ready")
    for attempt in range(1, MAX_ATTEMPTS + 1):
        due = LOG.due(LOG.last_states(LOG.read_log(spark, path)), MAX_ATTEMPTS)
        LOG.append(LOG.attempts(due, FX.send_answers(due)), path, RUN_DATE, f"attempt-{attempt}")
        LOG.compact(spark, path, RUN_DATE)
    return LOG.last_states(LOG.read_log(spark, path))


def _request_files(spark, d):
    """Request files of a second run: stories whose summary has landed are not asked again."""
    path = sub_dir(spark, f"requests/{uuid.uuid4().hex}")
    arrays = materialize(_arrays(spark, d))  # the links of a page are found once, for requests and replies
    requests = J3.inference_requests(_request_rows(spark, d, arrays), J3.tasks_table(spark))
    FILES.write_requests(requests, path, "first")
    key = F.concat_ws(":", F.lit("story"), F.col("feed_id").cast("string"), F.col("rank").cast("string")).alias("key")
    answered = J2.rows_where(_story_results(J1.stories_of(arrays)), F.col("summary").isNotNull(), key)
    FILES.write_requests(FILES.read_requests(spark, path, "first"), path, "second", answered)
    return FILES.read_requests(spark, path, "second").select("task", "key", "body")


register("outbox_sink")(_outbox_sink)
register("outbox_outcomes")(_outbox_outcomes)
register("request_files")(_request_files)
register("webhook_stream")(_webhook_stream)
