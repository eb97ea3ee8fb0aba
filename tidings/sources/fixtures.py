"""Inputs derived from the landed test tables with fixed, documented rules.

Every derivation is a narrow projection of a driver table, so the derived
inputs grow with the tables; webhooks, model calls and direct requests come
from the user turns of ``conversations``, as the service receives them.  Error
forms are seeded by id so that every branch of an operator is met.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.session import dealt


def _e(expr: str):
    return F.expr(expr)


# selections: one request per event --------------------------------------------
# feed = the page whose id equals the user id; index lists are arithmetic on
# event_id with zero, negative, repeated and out-of-range values; 0–5 items.
SELECTION_INDEXES = ("slice(array(event_id % 9, (event_id div 9) % 9, event_id % 4 - 1,"
                     " (event_id div 7) % 12, 1 + event_id % 5), 1, cast(event_id % 6 as int))")
SELECTION_LANG = ("CASE event_type WHEN 'view' THEN 'en' WHEN 'click' THEN 'zh-tw' "
                  "WHEN 'purchase' THEN 'fr' WHEN 'signup' THEN 'ZH-TW' ELSE 'en ' END")


def selections(events: DataFrame) -> DataFrame:
    """events -> (request_id, feed_id, user_id, language_code, indexes)."""
    return events.select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("feed_id"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_id"),
        _e(SELECTION_LANG).alias("language_code"),
        _e(SELECTION_INDEXES).alias("indexes"))


# feeds: a page each, with error forms by page_id --------------------------------
#: page_id % 23 -> what is wrong with the landed feed
FEED_FORMS = {3: "no answer", 5: "status 503", 7: "body cut short", 11: "no item", 13: "no title", 17: "no link",
              19: "no story link", 2: "no description"}


def landed_feeds(pages: DataFrame, links: Column | None = None) -> DataFrame:
    """pages -> (feed_id, http_status, body) with the error forms; ``links`` are the pages' links, if found already."""
    from tidings.sources.feeds import item, page_body, page_title, rss_body
    form = F.col("page_id") % 23
    none = F.lit(None).cast("string")
    title, link, html = page_title(), F.col("url"), F.col("html")
    broken = (F.when(form == 11, F.lit("")).when(form == 13, item(none, link, html)).when(form == 17, item(title, none, html))
               .when(form == 19, item(title, link, F.lit("<p>Nothing today</p>"))).when(form == 2, item(title, link, none)))
    whole = page_body(links)
    body = (F.when(form == 3, none).when(form == 7, F.substr(whole, F.lit(1), F.floor(F.length(whole) / 2).cast("int")))
             .when(broken.isNotNull(), rss_body(title, broken)).otherwise(whole))
    return pages.select(F.col("page_id").alias("feed_id"),
                        F.when(form == 3, F.lit(None).cast("int")).when(form == 5, 503).otherwise(200).alias("http_status"),
                        body.alias("body"))


# urls: page URLs, with bad and odd forms by page_id ------------------------------
URL_FORM = ("CASE page_id % 16 WHEN 1 THEN regexp_replace(url, '^[a-z]+:', 'ftp:') "
            "WHEN 2 THEN regexp_replace(url, '^[a-z]+://', '') "
            "WHEN 3 THEN concat('  ', url) "
            "WHEN 4 THEN regexp_extract(url, '^[a-z]+://', 0) "
            "WHEN 5 THEN upper(url) "
            "WHEN 6 THEN regexp_replace(url, '^([a-z]+://[^/?#]+)', '$1:99999') "
            "WHEN 7 THEN 'https://B\u00fccher.example/' || page_id "
            "WHEN 15 THEN 'http://\u65e5\u672c\u8a9e\u3002jp/' || page_id "
            "WHEN 8 THEN 'http://256.1.1.1/' || page_id "
            "WHEN 9 THEN 'http://[:::]/' || page_id "
            "WHEN 10 THEN regexp_replace(url, '^([a-z]+://[^/?#]+)', '$1:000080') "
            "WHEN 11 THEN 'http://%41.example/' || page_id "
            "WHEN 12 THEN 'https://[::1]/' || page_id "
            "WHEN 13 THEN 'http://1.2.3.4.5/' || page_id "
            "WHEN 14 THEN 'http://0x7f.1/' || page_id "
            "ELSE url END")


def urls(pages: DataFrame) -> DataFrame:
    """pages -> (request_id, user_id, language_code, url)."""
    return pages.select(
        F.col("page_id").alias("request_id"),
        F.concat(F.lit("U"), (F.col("page_id") % 150).cast("string")).alias("user_id"),
        _e("CASE page_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'zh-tw' ELSE 'ja' END").alias("language_code"),
        _e(URL_FORM).alias("url"))


# webhooks: user turns of conversations as signed chat-platform bodies ------------
# Fixed fixture key (a job parameter in real use; never a real secret).
FIXTURE_SECRET = "fixture-channel-secret"


WEBHOOK_VARIANT = "(conv_id * 7 + turn) % 20"


def request_key():
    """Key of a user turn: "{conv_id}:{turn}"."""
    return F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))


def _spark_jstr(x: str) -> str:
    return f"substring(to_json(array({x})), 2, length(to_json(array({x}))) - 2)"




def _webhook_body_sql(jtext: str, wid: str, cid: str, turn: str, v: str) -> str:
    """Body text by variant; shared by Spark (expr) and the DuckDB twin.

    0 no events · 1 follow · 2 message without message · 3 empty text ·
    4 not JSON · 5 event without source · 6 number as text · 7 follow then
    message · 8 trailing text · 9 unknown fields · 13 group source without
    userId · 14 no replyToken · others (incl. 10–12, signature cases) normal.
    """
    src = f"'\"source\":{{\"type\":\"user\",\"userId\":\"U' || {cid} || '\"}}'"
    rt = f"'\"replyToken\":\"rt-' || {wid} || '\",'"
    msg = f"'\"message\":{{\"type\":\"text\",\"text\":' || {jtext} || '}}'"
    normal = f"'{{\"type\":\"message\",' || {rt} || {src} || ',' || {msg} || '}}'"
    follow = f"'{{\"type\":\"follow\",' || {rt} || {src} || '}}'"
    return f"""CASE {v}
      WHEN 0 THEN '{{"events":[]}}'
      WHEN 1 THEN '{{"events":[' || {follow} || ']}}'
      WHEN 2 THEN '{{"events":[{{"type":"message",' || {rt} || {src} || '}}]}}'
      WHEN 3 THEN '{{"events":[{{"type":"message",' || {rt} || {src} || ',"message":{{"type":"text","text":""}}}}]}}'
      WHEN 4 THEN 'not json: ' || {jtext}
      WHEN 5 THEN '{{"events":[{{"type":"message",' || {msg} || '}}]}}'
      WHEN 6 THEN '{{"events":[{{"type":"message",' || {rt} || {src} || ',"message":{{"type":"text","text":' || {turn} || '}}}}]}}'
      WHEN 7 THEN '{{"events":[' || {follow} || ',' || {normal} || ']}}'
      WHEN 8 THEN '{{"events":[' || {normal} || ']}} trailing'
      WHEN 9 THEN '{{"destination":"Uabc","events":[{{"mode":"active","type":"message",' || {rt} || {src} || ',' || {msg} || '}}]}}'
      WHEN 13 THEN '{{"events":[{{"type":"message",' || {rt} || '"source":{{"type":"group","groupId":"G' || {cid} || '"}},' || {msg} || '}}]}}'
      WHEN 14 THEN '{{"events":[{{"type":"message",' || {src} || ',' || {msg} || '}}]}}'
      ELSE '{{"events":[' || {normal} || ']}}' END"""


def webhooks(conversations: DataFrame, secret: str = FIXTURE_SECRET) -> DataFrame:
    """User turns -> (webhook_id, feed_id, signature, body binary).

    The feed a webhook asks about is the page whose id is the conversation's.
    """
    from tidings.functions.crypto import hmac_sha256_base64

    users = conversations.where(F.col("role") == "user")
    base = users.select(
        request_key().alias("webhook_id"), F.col("conv_id").alias("feed_id"),
        F.expr(WEBHOOK_VARIANT).alias("v"),
        F.expr(_webhook_body_sql(_spark_jstr("text"), "concat_ws(':', conv_id, turn)",
                                 "CAST(conv_id AS STRING)", "CAST(turn AS STRING)",
                                 WEBHOOK_VARIANT)).alias("body_text"))
    signed = base.select("webhook_id", "feed_id", "v", F.encode("body_text", "UTF-8").alias("body"))
    good = hmac_sha256_base64(F.col("body"), secret)
    sig = (F.when(F.col("v") == 11, F.regexp_replace(good, "=+$", ""))
            .when(F.col("v") == 12, F.lit("not base64!"))
            .otherwise(good))
    body = F.when(F.col("v") == 10, F.concat(F.col("body"), F.lit(b" "))).otherwise(F.col("body"))
    return signed.select("webhook_id", "feed_id", sig.alias("signature"), body.alias("body"))


#: landing time of the first webhook
LANDING_START = datetime(2024, 1, 31, 8, tzinfo=timezone.utc)


def _landing(key: str, late_minutes):
    """LANDING_START plus up to 50 minutes by a hash of the webhook's id, plus ``late_minutes``."""
    minutes = F.pmod(F.xxhash64(key), F.lit(50)) + late_minutes
    return (F.lit(int(LANDING_START.timestamp())) + minutes * 60).cast("timestamp").alias("landed_at")


def landed_webhooks(webhooks: DataFrame) -> DataFrame:
    """webhooks with ``landed_at``."""
    return webhooks.select("*", _landing("webhook_id", F.lit(0)))


def landed_replies(replies: DataFrame) -> DataFrame:
    """tool replies with ``landed_at``: 0 to 40 minutes after their webhook."""
    return replies.select("*", _landing("key", F.pmod(F.xxhash64("key", F.lit("reply")), F.lit(41))))


# tool-call replies of the model, one per user turn ---------------------------------
def _tool_reply_sql(cid: str, turn: str, jstr, page_url: str = "NULL") -> str:
    """Reply body by variant (cid + 3*turn) % 8; status 500 / bad JSON by (cid+turn) % 11.

    0 reply_latest_story · 1 push_summary with mixed index types · 2
    push_url_summary · 3 content only · 4 unknown tool · 5 no choices · 6
    empty tool list with content · 7 push_summary with bad arguments.
    """
    def call(name, args_sql):
        return (f"'{{\"id\":\"chatcmpl-1\",\"object\":\"chat.completion\",\"choices\":[{{\"index\":0,"
                f"\"message\":{{\"role\":\"assistant\",\"content\":null,\"tool_calls\":[{{\"id\":\"call_1\","
                f"\"type\":\"function\",\"function\":{{\"name\":\"{name}\",\"arguments\":' || {jstr(args_sql)} || "
                f"'}}}}]}},\"finish_reason\":\"tool_calls\"}}]}}'")

    def content(text_sql, tools=""):
        return (f"'{{\"choices\":[{{\"index\":0,\"message\":{{\"role\":\"assistant\",{tools}\"content\":' || "
                f"{jstr(text_sql)} || '}},\"finish_reason\":\"stop\"}}]}}'")

    idx = (f"'{{\"indexes\":[' || CAST({cid} % 5 + 1 AS STRING) || ',' || CAST({turn} % 4 AS STRING) || ',' "
           f"|| CAST({cid} % 5 + 1 AS STRING) || ',-2,2.0,\"4\",null,true]}}'")
    url_v = (f"CASE {cid} % 4 WHEN 3 THEN 'ftp://files.example.com/' || CAST({cid} AS STRING) "
             f"ELSE coalesce({page_url}, 'https://news.example.com/item/' || CAST({cid} AS STRING)) END")
    url = f"'{{\"url\":' || {jstr(url_v)} || '}}'"
    v = f"(({cid} + 3 * {turn}) % 8)"
    return f"""CASE WHEN ({cid} + {turn}) % 11 = 9 THEN 'not json'
      ELSE CASE {v}
      WHEN 0 THEN {call('reply_latest_story', "'{}'")}
      WHEN 1 THEN {call('push_summary', idx)}
      WHEN 2 THEN {call('push_url_summary', url)}
      WHEN 3 THEN {content("'Reply to conversation ' || CAST(" + cid + " AS STRING)")}
      WHEN 4 THEN {call('get_weather', "'{" + '"city":"Taipei"' + "}'")}
      WHEN 5 THEN '{{"choices":[]}}'
      WHEN 6 THEN {content("'fallback message'", '"tool_calls":[],')}
      ELSE {call('push_summary', "'not json'")} END END"""


def tool_replies(conversations: DataFrame, pages: DataFrame) -> DataFrame:
    """User turns -> (key, http_status, body) as landed model replies.

    A push_url_summary call names the URL of the page whose id is the
    conversation id (when there is one).  The joined rows are few bytes
    that take long to write and parse as JSON; AQE, which goes by bytes, would
    leave them to one task, so they are dealt out evenly."""
    users = (conversations.where(F.col("role") == "user").select("conv_id", "turn")
             .join(pages.select(F.col("page_id").alias("conv_id"), F.col("url").alias("page_url")),
                   "conv_id", "left"))
    return dealt(users).select(
        request_key().alias("key"),
        F.expr("CASE WHEN (conv_id + turn) % 11 = 10 THEN 500 ELSE 200 END").alias("http_status"),
        F.expr(_tool_reply_sql("conv_id", "turn", _spark_jstr, "page_url")).alias("body"))


def conversation_requests(conversations: DataFrame) -> DataFrame:
    """User turns as raw request bytes; every 13th-variant one is not UTF-8."""
    users = conversations.where(F.col("role") == "user")
    raw = F.encode("text", "UTF-8")
    return users.select(
        request_key().alias("request_id"),
        F.when((F.col("conv_id") + F.col("turn")) % 13 == 7, F.concat(raw, F.lit(b"\xff")))
         .otherwise(raw).alias("body"))


# landed model replies for stories, digests, selections ---------------------------
def _chat_reply(content, form):
    """(status, body) columns of a chat reply: 1 HTTP 500, 2 no choice, 3 not JSON, else the content."""
    head = ('{"id":"r","object":"chat.completion","created":1,"model":"gpt-4o",'
            '"usage":{"prompt_tokens":1,"completion_tokens":1,"total_tokens":2},"choices":[')
    text = F.to_json(F.named_struct(F.lit("role"), F.lit("assistant"), F.lit("content"), content))
    full = F.concat(F.lit(head + '{"message":'), text, F.lit(',"finish_reason":"stop","index":0}]}'))
    body = F.when(form == 2, F.lit(head + "]}")).when(form == 3, F.lit("{broken")).otherwise(full)
    return F.when(form == 1, 500).otherwise(200).alias("http_status"), body.alias("body")


def story_replies(stories: DataFrame) -> DataFrame:
    """Stories -> (feed_id, rank, http_status, body); form (31 * feed + rank) % 7, where 0 never landed."""
    form = (F.col("feed_id") * 31 + F.col("rank")) % 7
    return (stories.select("feed_id", "rank", *_chat_reply(F.concat(F.lit("In short: "), F.col("story")), form), form.alias("form"))
                   .where("form <> 0").drop("form"))


def digest_replies(pages: DataFrame) -> DataFrame:
    """One reply per page feed, form page_id % 9, where 0 never landed."""
    form = F.col("page_id") % 9
    content = F.concat(F.lit("Today in feed "), F.col("page_id").cast("string"), F.lit("\n\nSecond part"))
    return (pages.select(F.col("page_id").alias("feed_id"), *_chat_reply(content, form), form.alias("form"))
                 .where("form <> 0").drop("form"))


def selection_replies(conversations: DataFrame) -> DataFrame:
    """One reply per user turn, form (conv_id + turn) % 5, where 0 never landed."""
    form = (F.col("conv_id") + F.col("turn")) % 5
    return (conversations.where(F.col("role") == "user")
            .select(request_key().alias("webhook_id"), *_chat_reply(F.concat(F.lit("Picked for "), request_key()), form), form.alias("form"))
            .where("form <> 0").drop("form"))


def translations(conversations: DataFrame) -> DataFrame:
    """(webhook_id, text): translations that have landed, for every third user turn."""
    return (conversations.where((F.col("role") == "user") & ((F.col("conv_id") + F.col("turn")) % 3 == 0))
            .select(request_key().alias("webhook_id"), F.concat(F.lit("Traduction de "), request_key()).alias("text")))


# texts in scripts without spaces ------------------------------------------------------
#: doc_id % 40 -> text before the id, and the label.  Odd ids are labelled by even ones, which hold
#: one Chinese text: so a Chinese text is met known and unknown, the other scripts unknown.
SCRIPT_TEXTS = {5: ("今天的新聞摘要，編號", "zh"), 10: ("天氣很好，我們去公園散步", "zh"), 15: ("きょうのニュースのまとめです。番号", "ja"),
                25: ("서울의 오늘 뉴스 요약", "ko"), 27: ("天氣很好，今天 news", "zh"), 35: ("เขาไปตลาดทุกวัน", "th")}


def language_documents(documents: DataFrame) -> DataFrame:
    """documents with texts of SCRIPT_TEXTS, numbered by the id, in place of some."""
    text, lang = F.col("text"), F.col("lang")
    for form, (words, label) in SCRIPT_TEXTS.items():
        here = F.col("doc_id") % 40 == form
        text = F.when(here, F.concat(F.lit(words), F.col("doc_id").cast("string"))).otherwise(text)
        lang = F.when(here, label).otherwise(lang)
    return documents.withColumn("text", text).withColumn("lang", lang)


# landed model replies for documents ----------------------------------------------
def _completion_sql(id_sql: str, content_sql: str, created_sql: str, usage: bool = True) -> str:
    u = ("'\"usage\":{\"prompt_tokens\":12,\"completion_tokens\":' || CAST(length(text) AS STRING) || "
         "',\"total_tokens\":' || CAST(length(text) + 12 AS STRING) || '},'") if usage else "''"
    return (f"'{{\"id\":\"chatcmpl-' || {id_sql} || '\",\"object\":\"chat.completion\",\"created\":' || "
            f"{created_sql} || ',\"model\":\"gpt-4o\",' || {u} || "
            f"'\"choices\":[{{\"message\":{{\"role\":\"assistant\",\"content\":' || {content_sql} || "
            f"'}},\"finish_reason\":\"stop\",\"index\":0}}]}}'")


def inference_replies_sql(jstr) -> tuple[str, str]:
    """(status, body) by doc_id % 11: 5 HTTP 500 · 7 not JSON · 8 no usage ·
    9 no choices · 10 trailing text · 6 content null · else the text."""
    full = _completion_sql("CAST(doc_id AS STRING)", jstr("text"), "CAST(1700000000 + doc_id AS STRING)")
    status = "CASE doc_id % 11 WHEN 5 THEN 500 ELSE 200 END"
    body = f"""CASE doc_id % 11
      WHEN 7 THEN 'not json'
      WHEN 8 THEN {_completion_sql("CAST(doc_id AS STRING)", jstr("text"), "CAST(1700000000 + doc_id AS STRING)", False)}
      WHEN 9 THEN '{{"id":"x","object":"chat.completion","created":1,"model":"gpt-4o","usage":{{"prompt_tokens":1,"completion_tokens":0,"total_tokens":1}},"choices":[]}}'
      WHEN 10 THEN {full} || ' trailing'
      WHEN 6 THEN {_completion_sql("CAST(doc_id AS STRING)", "'null'", "CAST(1700000000 + doc_id AS STRING)")}
      ELSE {full} END"""
    return status, body


def inference_replies(documents: DataFrame) -> DataFrame:
    """documents -> (key, http_status, body) landed chat replies."""
    status, body = inference_replies_sql(_spark_jstr)
    return documents.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("key"),
                            F.expr(status).alias("http_status"), F.expr(body).alias("body"))


def url_replies_sql(jstr) -> tuple[str, str]:
    """(status, body) by page_id % 9: 4 HTTP 502 · 5 error and data · 6
    neither · 7 not JSON · 8 meta without timing · else the page title."""
    title = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
    meta = "'\"meta\":{\"id\":\"m-' || CAST(page_id AS STRING) || '\",\"node\":\"us-east\",\"ms\":12,\"timing\":1.25}'"
    data = f"'\"data\":{{\"summary\":' || {jstr(title)} || ',\"tokens\":' || CAST(length(html) % 1000 AS STRING) || '}}'"
    status = "CASE page_id % 9 WHEN 4 THEN 502 ELSE 200 END"
    body = f"""CASE page_id % 9
      WHEN 5 THEN '{{' || {meta} || ',' || {data} || ',\"error\":\"rate limited\"}}'
      WHEN 6 THEN '{{' || {meta} || '}}'
      WHEN 7 THEN 'not json'
      WHEN 8 THEN '{{\"meta\":{{\"id\":\"m\"}},' || {data} || '}}'
      ELSE '{{' || {meta} || ',' || {data} || ',\"error\":null}}' END"""
    return status, body


def url_replies(pages: DataFrame) -> DataFrame:
    """pages -> (key = page_id, http_status, body) landed summarizer replies."""
    status, body = url_replies_sql(_spark_jstr)
    return pages.select(F.col("page_id").alias("key"), "url", F.expr(status).alias("http_status"),
                        F.expr(body).alias("body"))


# answers of the chat platform to sent messages ------------------------------------
def send_answers(due: DataFrame) -> DataFrame:
    """(message_id, http_status, body) for the next attempt of due messages, by the
    last number of the id modulo 7: 0 fails once with 500, 1 always fails with 429
    and no body, 2 has no answer, then 400, then succeeds; the others succeed."""
    form = F.regexp_extract("message_id", r"(\d+)$", 1).cast("bigint") % 7
    tries = F.col("attempt") + 1
    status = (F.when((form == 0) & (tries == 1), 500).when(form == 1, 429)
               .when((form == 2) & (tries == 1), F.lit(None)).when((form == 2) & (tries == 2), 400).otherwise(200))
    body = F.when(form != 1, F.concat(F.lit("try "), tries.cast("string")))
    return due.select("message_id", status.cast("int").alias("http_status"), body.alias("body"))
