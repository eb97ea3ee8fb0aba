"""J5 — webhook events, tool calls and routing (O32–O41).

Parsing follows serde's typed decoding: a body is accepted only when it is
one JSON document (no trailing text), every required field is present with
the right JSON type, and optional fields are absent, null or of the right
type; unknown fields are ignored.  Type checks use VARIANT, whose
``schema_of_variant`` keeps JSON strings, integers, decimals and doubles
apart (``from_json`` would coerce ``5`` into ``"5"``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.crypto import hmac_sha256_base64
from tidings.functions.jsonfn import (is_varray, is_vint, is_vnull_or_absent, is_vobject,
                                      is_vstring, last_members, vfield)
from tidings.functions.text import let

EVENTS_TYPE = ("array<struct<type:string,replyToken:string,"
               "source:struct<type:string,userId:string>,"
               "message:struct<type:string,text:string>>>")

# Tool names, default texts and error bodies of the reference.
TOOL_REPLY_LATEST = "reply_latest_story"
TOOL_PUSH_SUMMARY = "push_summary"
TOOL_PUSH_URL = "push_url_summary"
TEXT_NO_MESSAGE_CONTENT = "No message content"
ERROR_INVALID_UTF8 = "Invalid UTF-8 content"
ERROR_CONVERSATION = "Failed to process conversation"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_json(text) -> Column:
    """VARIANT of a text that is exactly one JSON document, else null; one parse.

    ``try_parse_json`` stops after the first value and ignores what follows.
    The text is parsed inside ``{"k":[text],"z":digest}``: text that ends the
    list early either breaks the document, adds a value or a key, or cuts off
    ``z``, whose value (the text's own digest) it cannot hold itself.
    """
    def checked(values: Column, parts: Column, digest: Column) -> Column:
        z = F.try_variant_get(F.try_element_at(parts, F.lit("z")), "$", "string")
        return F.when((F.size(parts) == 2) & (F.size(values) == 1) & (z == digest), F.get(values, F.lit(0)))

    def parsed(t: Column, digest: Column) -> Column:
        whole = F.try_parse_json(F.concat(F.lit('{"k":['), t, F.lit('],"z":"'), digest, F.lit('"}')))
        return let(F.try_variant_get(whole, "$", "map<string,variant>"), lambda parts: let(
            F.try_variant_get(F.try_element_at(parts, F.lit("k")), "$", "array<variant>"),
            lambda values: checked(values, parts, digest)))

    t = _c(text)
    return let(F.struct(t.alias("t"), F.md5(t.cast("binary")).alias("z")), lambda x: parsed(x["t"], x["z"]))


def dynamic_json(text) -> Column:
    """``strict_json`` of a value without a fixed shape: of an object's repeated
    keys the last one counts (a typed value with a repeated key is refused)."""
    return let(strict_json(text), lambda v: F.coalesce(v, strict_json(last_members(_c(text)))))


def _opt_string(v) -> Column:
    return is_vnull_or_absent(v) | is_vstring(v)


# O32 -------------------------------------------------------------------------
def verify_signatures(webhooks: DataFrame, secret: str) -> DataFrame:
    """Adds ``signature_ok``: base64 HMAC-SHA256(secret, body) equals the
    header.  Canonical standard base64 is unique, so text equality is the
    strict decode-then-compare of the reference."""
    expected = hmac_sha256_base64(F.col("body"), secret)
    return webhooks.withColumn("signature_ok", F.coalesce(F.col("signature") == expected,
                                                          F.lit(False)))


# O33 -------------------------------------------------------------------------
def _event_ok(e) -> Column:
    src, msg = vfield(e, "$.source"), vfield(e, "$.message")
    msg_ok = is_vnull_or_absent(msg) | (
        is_vobject(msg) & is_vstring(vfield(msg, "$.type")) & _opt_string(vfield(msg, "$.text")))
    return (is_vobject(e) & is_vstring(vfield(e, "$.type"))
            & _opt_string(vfield(e, "$.replyToken"))
            & is_vobject(src) & is_vstring(vfield(src, "$.type"))
            & _opt_string(vfield(src, "$.userId")) & msg_ok)


def parse_webhooks(webhooks: DataFrame) -> DataFrame:
    """Adds ``parse_ok`` and the typed ``events`` (null when rejected).

    All-or-nothing per body: bad UTF-8, bad JSON, trailing text, or any
    event lacking a required field or with a wrong type rejects the body.
    Each stage is its own projection so no large expression is repeated.
    """
    s = webhooks.withColumn("_t", F.when(F.is_valid_utf8(F.col("body").cast("string")),
                                         F.col("body").cast("string")))
    s = s.withColumn("_v", strict_json(F.col("_t"))).drop("_t")
    s = s.withColumn("_evs", vfield("_v", "$.events"))
    s = s.withColumn("parse_ok", F.coalesce(
        is_vobject("_v") & is_varray("_evs")
        & F.forall(F.try_variant_get(F.col("_evs"), "$", "array<variant>"), _event_ok),
        F.lit(False)))
    return (s.withColumn("events", F.when(F.col("parse_ok"), F.try_variant_get(
                F.col("_evs"), "$", EVENTS_TYPE)))
             .drop("_v", "_evs"))


# O34 -------------------------------------------------------------------------
def first_event_outcome(webhooks: DataFrame, secret: str, also=()) -> DataFrame:
    """One row per webhook: outcome in the reference's order of checks,
    plus the first event's reply token, user id and text when accepted.
    A ``feed_id`` of the webhook and the columns in ``also`` are carried along."""
    feed = [*(c for c in ("feed_id",) if c in webhooks.columns), *also]
    p = parse_webhooks(verify_signatures(webhooks, secret))
    p = p.select("webhook_id", *feed, "signature_ok", "parse_ok", "events",
                 F.try_element_at(F.col("events"), F.lit(1)).alias("_e"))
    e = F.col("_e")
    text = e["message"]["text"]
    outcome = (F.when(~F.col("signature_ok"), "bad_signature")
                .when(~F.col("parse_ok"), "parse_error")
                .when(F.size("events") == 0, "no_events")
                .when(e["type"] != "message", "not_message")
                .when(e["message"].isNull(), "no_message")
                .when(text.isNull() | (text == ""), "no_text")
                .otherwise("accepted"))
    o = p.select("webhook_id", *feed, "_e", outcome.alias("outcome"))
    acc = F.col("outcome") == "accepted"
    return o.select("webhook_id", *feed, "outcome",
                    F.when(acc, e["replyToken"]).alias("reply_token"),
                    F.when(acc, e["source"]["userId"]).alias("user_id"),
                    F.when(acc, text).alias("text"))


# O35 -------------------------------------------------------------------------
def _tool_call_ok(t) -> Column:
    fn = vfield(t, "$.function")
    return (is_vobject(t) & is_vobject(fn) & is_vstring(vfield(fn, "$.name"))
            & is_vstring(vfield(fn, "$.arguments")))


def decode_tool_calls(replies: DataFrame, also=()) -> DataFrame:
    """Model replies -> first tool call (name, arguments) or the message
    content; status ok / ai_error (no choices) / serialization_error /
    external_error (HTTP not 2xx).  ``result`` is the reference's JSON.
    Columns named in ``also`` are carried along."""
    s = replies.withColumn("_v", strict_json(F.col("body")))
    s = s.withColumn("_ch", vfield("_v", "$.choices"))
    s = s.withColumn("_carr", F.try_variant_get(F.col("_ch"), "$", "array<variant>"))

    def choice_ok(ch):
        m = vfield(ch, "$.message")
        tc = vfield(m, "$.tool_calls")
        tarr = F.try_variant_get(tc, "$", "array<variant>")
        return (is_vobject(ch) & is_vobject(m) & _opt_string(vfield(m, "$.content"))
                & (is_vnull_or_absent(tc) | (is_varray(tc) & F.forall(tarr, _tool_call_ok))))

    shape_ok = F.coalesce(is_vobject("_v") & is_varray("_ch") & F.forall("_carr", choice_ok),
                          F.lit(False))
    http_ok = F.col("http_status").between(200, 299)
    status = (F.when(~http_ok, "external_error")
               .when(~shape_ok, "serialization_error")
               .when(F.size("_carr") == 0, "ai_error")
               .otherwise("ok"))
    s = s.select("key", *also, status.alias("status"),
                 vfield(F.try_element_at(F.col("_carr"), F.lit(1)), "$.message").alias("_msg"))
    s = s.select("key", *also, "status", "_msg",
                 F.try_element_at(F.try_variant_get(F.col("_msg"), "$.tool_calls", "array<variant>"),
                                  F.lit(1)).alias("_call"))
    ok = F.col("status") == "ok"
    has_call = F.col("_call").isNotNull()
    out = s.select(
        "key", *also, "status",
        F.when(ok & has_call, F.try_variant_get(F.col("_call"), "$.function.name", "string")).alias("name"),
        F.when(ok & has_call, F.try_variant_get(F.col("_call"), "$.function.arguments", "string"))
         .alias("arguments"),
        F.when(ok & ~has_call, F.try_variant_get(F.col("_msg"), "$.content", "string")).alias("message"))
    return out.select(
        "key", *also, "status", "name", "arguments", "message",
        F.when(F.col("status") == "ok",
               F.to_json(F.struct("name", "arguments", "message"))).alias("result"))


# O36 -------------------------------------------------------------------------
def tool_requests(df: DataFrame, text_col: str, keys, model: str) -> DataFrame:
    """Request body with the three tool definitions and tool_choice auto
    (keys sorted, as the reference's json! maps serialise)."""
    from tidings.operators.tools import TOOLS_JSON
    j = F.to_json(F.array(F.col(text_col)))
    jtext = F.substring(j, F.lit(2), F.length(j) - 2)
    body = F.concat(F.lit('{"messages":[{"content":'), jtext,
                    F.lit(f',"role":"user"}}],"model":"{model}","tool_choice":"auto","tools":'),
                    F.lit(TOOLS_JSON), F.lit("}"))
    return df.select(*keys, body.alias("body"))


# O37 -------------------------------------------------------------------------
def route_calls(events: DataFrame, calls: DataFrame) -> DataFrame:
    """Accepted first events joined to their decoded tool call -> route.

    reply_latest_story needs a reply token, push_summary and
    push_url_summary need a user id, anything else pushes the message text
    and needs a user id and a message; a route missing its key is dropped.
    ``feed_id`` and ``language`` of the events are carried along.
    """
    return routes_of(events.join(calls.withColumnRenamed("key", "webhook_id"), "webhook_id", "left"))


def routes_of(j: DataFrame) -> DataFrame:
    """Routes of events that are joined to their call already; no status is no reply."""
    also = [c for c in ("feed_id", "language") if c in j.columns]
    name = F.col("name")
    route = (F.when(F.col("outcome") != "accepted", F.lit(None))
              .when(F.col("status").isNull() | (F.col("status") != "ok"), "model_error")
              .when(name == TOOL_REPLY_LATEST, "reply_latest_story")
              .when(name == TOOL_PUSH_SUMMARY, "push_summary")
              .when(name == TOOL_PUSH_URL, "push_url_summary")
              .otherwise("push_message"))
    j = j.withColumn("route", route)
    r = F.col("route")
    has_user, has_token = F.col("user_id").isNotNull(), F.col("reply_token").isNotNull()
    outcome = (F.when(r.isNull(), F.col("outcome"))
                .when(r == "model_error", "model_error")
                .when((r == "reply_latest_story") & ~has_token, "dropped_no_reply_token")
                .when(r.isin("push_summary", "push_url_summary", "push_message") & ~has_user,
                      "dropped_no_user")
                .when((r == "push_message") & F.col("message").isNull(), "no_message")
                .otherwise("routed"))
    return j.select("webhook_id", "route", outcome.alias("outcome"),
                    "reply_token", "user_id", "text", "name", "arguments", "message", *also)


# O38 -------------------------------------------------------------------------
def index_array(arguments) -> Column:
    """Second parse of the call arguments: ``indexes`` elements that are
    unsigned integers, in order, duplicates kept (as_u64 semantics: 2.0,
    "4", null, booleans and negatives are dropped one by one); bad JSON or
    no list -> empty."""
    arr = F.try_variant_get(dynamic_json(_c(arguments)), "$.indexes", "array<variant>")
    kept = F.filter(arr, lambda x: is_vint(x) & (F.try_variant_get(x, "$", "bigint") >= 0))
    return F.coalesce(F.transform(kept, lambda x: F.try_variant_get(x, "$", "bigint")),
                      F.array().cast("array<bigint>"))


def call_indexes(routes: DataFrame) -> DataFrame:
    """push_summary arguments -> (webhook_id, pos, idx) rows."""
    r = routes.where((F.col("route") == "push_summary") & (F.col("outcome") == "routed"))
    return (r.select("webhook_id", F.posexplode(index_array("arguments")).alias("pos", "idx"))
             .select("webhook_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "idx"))


# O39 -------------------------------------------------------------------------
def call_urls(routes: DataFrame, also=()) -> DataFrame:
    """push_url_summary arguments -> url when it is a JSON string."""
    r = routes.where((F.col("route") == "push_url_summary") & (F.col("outcome") == "routed"))
    u = F.col("_u")
    url = F.when(is_vstring(u), F.try_variant_get(u, "$", "string"))
    # explode of a 0/1-element array instead of a filter on the derived url:
    # a filter would be pushed through the join and inline the reply parse
    return (r.select("webhook_id", "user_id", *also, vfield(dynamic_json(F.col("arguments")), "$.url").alias("_u"))
             .select("webhook_id", "user_id", *also,
                     F.explode(F.filter(F.array(url), lambda x: x.isNotNull())).alias("url")))


# O40 -------------------------------------------------------------------------
def conversation_replies(requests: DataFrame, calls: DataFrame) -> DataFrame:
    """Direct chat endpoint: 400 on bad UTF-8, 500 when the model call
    failed, the call object echoed (keys sorted) when a tool was named,
    else {"message": content or the default text}."""
    j = requests.join(calls.withColumnRenamed("key", "request_id"), "request_id", "left")
    utf8 = F.is_valid_utf8(F.col("body").cast("string"))
    ok = F.col("status") == "ok"
    named = F.col("name").isNotNull()
    echo = F.to_json(F.struct(F.col("arguments").alias("arguments"), F.col("name").alias("name")))
    plain = F.to_json(F.struct(F.coalesce(F.col("message"), F.lit(TEXT_NO_MESSAGE_CONTENT))
                               .alias("message")))
    code = F.when(~utf8, 400).when(~F.coalesce(ok, F.lit(False)), 500).otherwise(200)
    resp = (F.when(~utf8, F.to_json(F.struct(F.lit(ERROR_INVALID_UTF8).alias("error"))))
             .when(~F.coalesce(ok, F.lit(False)),
                   F.to_json(F.struct(F.lit(ERROR_CONVERSATION).alias("error"))))
             .when(named, echo).otherwise(plain))
    return j.select("request_id", code.alias("http_code"), resp.alias("response"))


# O41 -------------------------------------------------------------------------
def webhook_funnel(routes: DataFrame) -> DataFrame:
    """Counts per (outcome, route) — the table form of the reference's logs."""
    return routes.groupBy("outcome", "route").agg(F.count(F.lit(1)).alias("n"))
