"""End-to-end jobs: the reference's routes as batch jobs.

Each job is a pure DataFrame plan from landed inputs to outbox rows (keys,
channel, recipient, payload, status, error_text): one row for every feed or
request, also for those that fail.  Landed model replies come in as parsed
results (O16, O17); the stand-ins fill in only where no reply has landed.
Parameters (secret, run date) are arguments, never globals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.text import let
from tidings.operators import digests as J2
from tidings.operators import enrich as J3
from tidings.operators import feeds as J1
from tidings.operators import outbox as J4
from tidings.operators import webhooks as J5
from tidings.session import materialize

# The reference's error texts of its broadcast and push routes.
TEXT_INVALID_URL = "Invalid URL provided"
TEXT_BROADCAST_NETWORK = "Network error while fetching stories for broadcast"
TEXT_BROADCAST_ERROR = "RSS feed service error during broadcast preparation"
TEXT_SUMMARY_NETWORK = "Network error while fetching stories for summary"
TEXT_SUMMARY_ERROR = "RSS feed service error during summary preparation"
TEXT_AI_ERROR = "ChatGPT API error during summary generation"
TEXT_AI_EXTERNAL = "ChatGPT service unavailable"
TEXT_AI_OTHER = "Failed to create AI summary"

OUTBOX = ("channel", "recipient", "payload", "status", "error_text", "request_text")


def ai_error(status: Column) -> Column:
    """Error text of a landed reply's status; null when it is ok or absent."""
    return (F.when(status == "ai_error", TEXT_AI_ERROR).when(status == "external_error", TEXT_AI_EXTERNAL)
             .when(status != "ok", TEXT_AI_OTHER))


def _broadcast_rows(df: DataFrame, message: Column, error: Column) -> DataFrame:
    return df.select("feed_id", error.alias("error_text"), F.when(error.isNull(), message).alias("message")).select(
        "feed_id", F.lit("broadcast").alias("channel"), F.lit(None).cast("string").alias("recipient"),
        F.when(F.col("error_text").isNull(), J4.broadcast_envelope("message")).alias("payload"),
        F.when(F.col("error_text").isNull(), J4.READY).otherwise(J4.ERROR).alias("status"), "error_text")


def story_broadcast(feeds: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """GET sendTodayStories: newest stories -> summaries (default on
    failure) -> one carousel per feed -> broadcast envelope.

    ``results`` (feed_id, rank, summary) are landed summaries; without them
    each title's own extract stands in and the job has no shuffle.
    """
    found = J1.feed_stories(feeds)
    if results is None:
        found = found.select("feed_id", "status", J3.story_summaries(F.col("stories")).alias("stories"))
    else:
        found = J3.enrich_arrays(found, results)
    return _broadcast_rows(found, J4.carousel(F.col("stories")),
                           J1.feed_error(F.col("status"), TEXT_BROADCAST_NETWORK, TEXT_BROADCAST_ERROR))


def daily_summary(feeds: DataFrame, run_date: str, results: DataFrame | None = None) -> DataFrame:
    """GET broadcastDailySummary: newest stories -> digest summary -> bubble
    -> broadcast envelope.

    ``results`` (feed_id, status, content) are landed digest summaries; the
    digest highlights stand in where none has landed.
    """
    found = J1.feed_stories(feeds)
    stand_in = F.when(F.size("stories") > 0, J3.highlight_of(F.col("stories"))["highlight"])
    if results is None:
        text, failed = stand_in, F.lit(None).cast("string")
    else:
        landed = results.select("feed_id", F.col("status").alias("_reply"), "content")
        found = found.join(landed, "feed_id", "left")
        text = F.when(F.col("_reply") == "ok", F.col("content")).when(F.col("_reply").isNull(), stand_in)
        failed = ai_error(F.col("_reply"))
    error = F.coalesce(J1.feed_error(F.col("status"), TEXT_SUMMARY_NETWORK, TEXT_SUMMARY_ERROR), failed)
    rows = found.select("feed_id", error.alias("_error"), text.alias("_text"))
    return _broadcast_rows(rows, J4.summary_bubble(F.col("_text"), run_date), F.col("_error"))


def _routed(routes: DataFrame, route: str) -> DataFrame:
    return routes.where((F.col("route") == route) & (F.col("outcome") == "routed"))


def webhook_routes(webhooks: DataFrame, replies: DataFrame, secret: str, profiles: DataFrame) -> DataFrame:
    """Signature -> parse -> first event -> language -> tool call -> route.

    The parsed events are read twice, for their words and for their routes.
    """
    events = materialize(J5.first_event_outcome(webhooks, secret))
    return J5.route_calls(J3.with_language(events, profiles), J5.decode_tool_calls(replies))


def of_wanted(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose key is wanted; applied to raw tables, so that
    only wanted rows are parsed, cleaned or searched for links."""
    return table.join(wanted.select(key).distinct(), key, "left_semi")


def asked_pages(pages: DataFrame, routes: DataFrame, route: str) -> DataFrame:
    """Pages whose feed a request of the route asks about."""
    return of_wanted(pages, _routed(routes, route).select(F.col("feed_id").alias("page_id")), "page_id")


def _pushes(df: DataFrame, key: str, run_date: str, rejected: Column, summary: Column, failed: Column,
            translations: DataFrame | None) -> DataFrame:
    """Outbox rows of summaries pushed to a user: ready, rejected, failed, or
    waiting for the translation that ``request_text`` asks for (O14)."""
    df = df.select(F.col(key).alias("webhook_id"), F.col("user_id").alias("recipient"), F.col("language").alias("_lang"),
                   rejected.alias("_rejected"), failed.alias("_failed"), summary.alias("_summary"))
    translated = F.lit(None).cast("string")
    if translations is not None:
        df = df.join(translations.select("webhook_id", F.col("text").alias("_translated")), "webhook_id", "left")
        translated = F.col("_translated")
    wants = F.coalesce(J2.needs_translation("_lang"), F.lit(False))
    text = F.when(wants, translated).otherwise(F.col("_summary"))
    status = (F.when(F.col("_rejected").isNotNull(), J4.REJECTED).when(F.col("_failed").isNotNull(), J4.ERROR)
               .when(wants & translated.isNull(), J4.NEEDS_TRANSLATION).otherwise(J4.READY))
    out = df.select("webhook_id", "recipient", "_lang", "_summary", status.alias("status"),
                    F.coalesce("_rejected", "_failed").alias("error_text"), text.alias("_text"))
    ready = F.col("status") == J4.READY
    return out.select(
        "webhook_id", F.lit("push").alias("channel"), "recipient",
        F.when(ready, J4.push_envelope("recipient", J4.summary_bubble(F.col("_text"), run_date))).alias("payload"),
        "status", "error_text",
        F.when(F.col("status") == J4.NEEDS_TRANSLATION, J3.translate_content("_lang", "_summary")).alias("request_text"))


def push_summaries(routes: DataFrame, feeds: DataFrame, run_date: str, results: DataFrame | None = None,
                   translations: DataFrame | None = None) -> DataFrame:
    """push_summary calls: the user's indexes -> picked stories of the
    request's feed -> their summary -> translation if needed -> bubble.

    ``feeds`` holds (feed_id, stories); ``results`` (webhook_id, status,
    content) landed summaries; ``translations`` (webhook_id, text).
    """
    wanted = _routed(routes, "push_summary").select("webhook_id", "feed_id", "user_id", "language",
                                                    J5.index_array("arguments").alias("indexes"))
    picked = J2.picked_stories(wanted, feeds)
    some = F.size("stories") > 0
    rejected = F.when(~some, J2.TEXT_NO_VALID_SELECTION)
    summary, failed = F.when(some, J3.highlight_of(F.col("stories"))["highlight"]), F.lit(None).cast("string")
    if results is not None:
        landed = results.select("webhook_id", F.col("status").alias("_reply"), "content")
        picked = picked.join(landed, "webhook_id", "left")
        summary = F.when(F.col("_reply") == "ok", F.col("content")).when(F.col("_reply").isNull(), summary)
        failed = ai_error(F.col("_reply"))
    return _pushes(picked, "webhook_id", run_date, rejected, summary, failed, translations)


def page_summaries(pages: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(url, stand_in) for the wanted URLs that have landed, or all: the
    extract of the page with the smallest id.  Only wanted pages are cleaned."""
    chosen = ((pages if wanted is None else of_wanted(pages, wanted, "url"))
                   .groupBy("url").agg(F.min(F.struct("page_id", "html")).alias("p")).select("url", "p.html"))
    return chosen.select("url", let(J3.page_text("html"), lambda t: J3.summary_of(t, 3, 200)).alias("stand_in"))


def push_url(routes: DataFrame, pages: DataFrame, run_date: str, results: DataFrame | None = None,
             translations: DataFrame | None = None) -> DataFrame:
    """push_url_summary calls: URL -> validity -> landed summary, or the
    landed page's extract -> translation if needed -> bubble; one row per
    request.  ``results`` holds (url, status, summary), one row per URL.
    """
    return _push_urls(routes, page_summaries(pages, J5.call_urls(routes)), run_date, results, translations)


def _push_urls(routes: DataFrame, extracts: DataFrame, run_date: str, results: DataFrame | None,
               translations: DataFrame | None) -> DataFrame:
    """``push_url`` with the pages' extracts (url, stand_in)."""
    from tidings.functions.url import is_valid_url
    urls = J5.call_urls(routes, ("feed_id", "language"))
    df = urls.join(extracts, "url", "left")
    summary, missing = F.col("stand_in"), F.col("stand_in").isNull()
    failed = F.when(missing, "No summary data returned")
    if results is not None:
        landed = results.select("url", F.col("status").alias("_reply"), F.col("summary").alias("_landed"))
        df = df.join(landed, "url", "left")
        summary = F.when(F.col("_reply") == "ok", F.col("_landed")).otherwise(F.col("stand_in"))
        failed = F.when(F.col("_reply") != "ok", F.col("_reply")).when(F.col("_reply").isNull() & missing, "No summary data returned")
    rejected = F.when(~is_valid_url("url"), TEXT_INVALID_URL)
    return _pushes(df, "webhook_id", run_date, rejected, summary, failed, translations)


def landed_url_results(replies: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(url, status, summary) of landed summarizer replies (key, url,
    http_status, body): one per URL, of the smallest key.  Only the replies to
    wanted URLs are parsed."""
    replies = replies if wanted is None else of_wanted(replies, wanted, "url")
    parsed = J3.url_summary_results(replies, ("key", "url"))
    return (parsed.groupBy("url").agg(F.min(F.struct("key", "status", "summary")).alias("r"))
                  .select("url", "r.status", "r.summary"))


def landed_selection_results(replies: DataFrame, routes: DataFrame) -> DataFrame:
    """(webhook_id, status, content) of landed chat replies (webhook_id,
    http_status, body) to selections.  Only the replies to a push_summary
    request are parsed."""
    return J3.inference_results(of_wanted(replies, _routed(routes, "push_summary"), "webhook_id"), ("webhook_id",))


def webhook_outbox(routes: DataFrame, headlines: DataFrame) -> DataFrame:
    """Routes answered directly: reply_latest_story -> reply with the
    headline of the request's feed, or the reason why there is none;
    push_message -> push the text."""
    heads = headlines.select("feed_id", F.col("text").alias("_headline"), F.col("error_text").alias("_why"))
    reply = _routed(routes, "reply_latest_story").join(heads, "feed_id", "left")
    why = F.when(F.col("_headline").isNull(), F.coalesce("_why", F.lit(J2.TEXT_NO_STORIES)))
    none = F.lit(None).cast("string").alias("request_text")
    replies = reply.select(
        "webhook_id", F.lit("reply").alias("channel"), F.col("reply_token").alias("recipient"),
        F.when(why.isNull(), J4.reply_envelope("reply_token", J4.text_message("_headline"))).alias("payload"),
        F.when(why.isNull(), J4.READY).otherwise(J4.ERROR).alias("status"), why.alias("error_text"), none)
    push = _routed(routes, "push_message").select(
        "webhook_id", F.lit("push").alias("channel"), F.col("user_id").alias("recipient"),
        J4.push_envelope("user_id", J4.text_message("message")).alias("payload"),
        F.lit(J4.READY).alias("status"), F.lit(None).cast("string").alias("error_text"), none)
    return replies.unionByName(push)


def page_headlines(pages: DataFrame) -> DataFrame:
    """Headline per page feed (the page is the feed's newest item)."""
    from tidings.sources.feeds import page_title
    return J2.latest_headline(pages.select(F.col("page_id").alias("feed_id"), page_title().alias("title"),
                                           F.col("url").alias("link")))


def all_outbox(routes: DataFrame, headlines: DataFrame, feeds: DataFrame, extracts: DataFrame, run_date: str,
               results: DataFrame | None = None, url_results: DataFrame | None = None,
               translations: DataFrame | None = None) -> DataFrame:
    """Outbox rows of all four routes; ``extracts`` holds (url, stand_in)."""
    return (webhook_outbox(routes, headlines)
            .unionByName(push_summaries(routes, feeds, run_date, results, translations))
            .unionByName(_push_urls(routes, extracts, run_date, url_results, translations)))


def process_webhooks(webhooks: DataFrame, replies: DataFrame, secret: str, profiles: DataFrame, pages: DataFrame,
                     run_date: str, results: DataFrame | None = None, url_replies: DataFrame | None = None,
                     translations: DataFrame | None = None, selection_replies: DataFrame | None = None) -> DataFrame:
    """POST webhook as a batch job: every route with its outbox row.

    Pages, URL replies and ``selection_replies`` (landed chat replies, in place
    of ``results``) are cut to the requests before any work on them.
    """
    routes = materialize(webhook_routes(webhooks, replies, secret, profiles))  # read by four routes
    if selection_replies is not None:
        results = landed_selection_results(selection_replies, routes)
    urls = J5.call_urls(routes)
    out = all_outbox(routes, page_headlines(asked_pages(pages, routes, "reply_latest_story")),
                     J1.page_story_arrays(asked_pages(pages, routes, "push_summary")), page_summaries(pages, urls), run_date,
                     results, None if url_replies is None else landed_url_results(url_replies, urls), translations)
    return (routes.select("webhook_id", "route", "outcome", "language")
                  .join(out, "webhook_id", "left"))
