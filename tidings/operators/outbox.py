"""J4 — rendering and outbox (O23–O31).

Cards are built as Spark structs (``obj``/``union_obj`` give the sorted
key order the reference's JSON maps have) and serialised once with
``to_json`` at the envelope, so the whole render stays inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.jsonfn import obj, union_obj
from tidings.functions.text import split_sections, truncate_chars, unicode_trim

# Fixed values of the reference's cards: texts, colours, sizes, limits.
TITLE_LIMIT = 100
SUMMARY_LIMIT = 200
CAROUSEL_ALT_TEXT = "Today's Hacker News Stories"
SUMMARY_ALT_TEXT = "Today's Hacker News Summary"
BRAND_TEXT = "Hacker News"
BUTTON_LABEL = "Read Article"
SUMMARY_TITLE = "Today's Summary"
SUMMARY_ICON = "📰"
ACCENT = "#FF6B35"
HEADER_BG = "#FFF5F0"
BRAND_COLOR = "#AAAAAA"
TITLE_COLOR = "#1A1A1A"
SUMMARY_COLOR = "#666666"
SECTION_COLOR = "#333333"
WHITE = "#FFFFFF"
DATE_COLOR = "#FFFFFFCC"

# Shapes of the arrays whose elements differ (key -> type); keys sorted on output.
_TEXT_SHAPE = {"color": "string", "flex": "int", "margin": "string", "size": "string",
               "text": "string", "type": "string", "weight": "string", "wrap": "boolean"}
_HEADER_ITEM = ("struct<color:string,flex:int,margin:string,size:string,text:string,"
                "type:string,weight:string>")
_SUMMARY_HEADER_SHAPE = {"color": "string", "contents": f"array<{_HEADER_ITEM}>",
                         "layout": "string", "margin": "string", "size": "string",
                         "text": "string", "type": "string"}
_HEADER_ITEM_SHAPE = {k: v for k, v in _TEXT_SHAPE.items() if k != "wrap"}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# O23 -------------------------------------------------------------------------
def truncate_text(df: DataFrame, text_col: str, keys, limits=(TITLE_LIMIT, SUMMARY_LIMIT)) -> DataFrame:
    cols = [truncate_chars(text_col, n).alias(f"cut_{n}") for n in limits]
    return df.select(*keys, F.char_length(text_col).cast("bigint").alias("n_chars"), *cols)


# O24 -------------------------------------------------------------------------
def text_message(text) -> Column:
    """LineMessage text: {"type":"text","text":…} (struct, serialise later)."""
    return F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), _c(text))


def text_messages(df: DataFrame, text_col: str, keys) -> DataFrame:
    return df.select(*keys, F.to_json(text_message(text_col)).alias("payload"))


# O25 -------------------------------------------------------------------------
def story_bubble(rank, title, link, summary) -> Column:
    rank, title, link, summary = map(_c, (rank, title, link, summary))
    hi = _HEADER_ITEM_SHAPE
    header = obj(
        backgroundColor=HEADER_BG, layout="vertical", paddingAll="15px", type="box",
        contents=F.array(obj(layout="baseline", type="box", contents=F.array(
            union_obj(hi, color=ACCENT, flex=0, size="sm", type="text", weight="bold",
                      text=F.concat(F.lit("#"), rank.cast("string"))),
            union_obj(hi, color=BRAND_COLOR, margin="md", size="xs", text=BRAND_TEXT,
                      type="text")))))
    ts = _TEXT_SHAPE
    body = obj(
        layout="vertical", paddingAll="15px", spacing="md", type="box",
        contents=F.array(
            union_obj(ts, color=TITLE_COLOR, margin="none", size="md", type="text",
                      weight="bold", wrap=True, text=truncate_chars(title, TITLE_LIMIT)),
            union_obj(ts, margin="md", type="separator"),
            union_obj(ts, color=SUMMARY_COLOR, margin="md", size="sm", type="text",
                      wrap=True, text=truncate_chars(summary, SUMMARY_LIMIT))))
    footer = obj(
        layout="vertical", paddingAll="13px", spacing="sm", type="box",
        contents=F.array(obj(
            action=obj(label=BUTTON_LABEL, type="uri", uri=link),
            color=ACCENT, height="sm", style="primary", type="button")))
    return obj(body=body, footer=footer, header=header, size="kilo", type="bubble")


def flex_message(alt_text: str, contents: Column) -> Column:
    """LineMessage flex: fields in declaration order type, altText, contents."""
    return F.named_struct(F.lit("type"), F.lit("flex"), F.lit("altText"), F.lit(alt_text),
                          F.lit("contents"), contents)


def carousel(stories: Column) -> Column:
    """Carousel message of an array of (rank, storylink, story, summary)."""
    bubbles = F.transform(stories, lambda s: story_bubble(s["rank"], s["story"], s["storylink"], s["summary"]))
    return flex_message(CAROUSEL_ALT_TEXT, obj(contents=bubbles, type="carousel"))


def story_carousel(feeds: DataFrame, keys=("feed_id",)) -> DataFrame:
    """(keys…, stories with rank and summary) -> one carousel message per feed with stories."""
    from tidings.operators.digests import rows_where
    n = F.size("stories")
    return rows_where(feeds, n > 0, *keys, n.cast("bigint").alias("n_bubbles"), carousel(F.col("stories")).alias("message"))


# O26 -------------------------------------------------------------------------
def summary_sections(df: DataFrame, text_col: str, keys) -> DataFrame:
    """One row per "\\n\\n" section (empties kept), trimmed; section_no from 1."""
    return (df.select(*keys, F.posexplode(split_sections(text_col)).alias("pos", "s"))
              .select(*keys, (F.col("pos") + 1).cast("bigint").alias("section_no"),
                      unicode_trim("s").alias("section")))


# O27 -------------------------------------------------------------------------
def summary_bubble(summary, run_date: str) -> Column:
    """Flex bubble for a summary text; the header date is a job parameter."""
    ts = {k: v for k, v in _TEXT_SHAPE.items() if k not in ("flex", "weight")}

    def section(s, i):
        text = union_obj(ts, color=SECTION_COLOR, size="sm", type="text", wrap=True,
                         text=unicode_trim(s),
                         margin=F.when(i > 0, "md").otherwise("none"))
        sep = union_obj(ts, margin="xl", type="separator")
        return F.when(i > 0, F.array(sep, text)).otherwise(F.array(text))

    contents = F.flatten(F.transform(split_sections(summary), section))
    hs, hi = _SUMMARY_HEADER_SHAPE, _HEADER_ITEM_SHAPE
    header = obj(
        backgroundColor=ACCENT, layout="vertical", paddingAll="20px", type="box",
        contents=F.array(
            union_obj(hs, layout="baseline", type="box", contents=F.array(
                union_obj(hi, flex=0, size="xl", text=SUMMARY_ICON, type="text"),
                union_obj(hi, color=WHITE, margin="md", size="xl", text=SUMMARY_TITLE,
                          type="text", weight="bold"))),
            union_obj(hs, color=DATE_COLOR, margin="md", size="xs", text=run_date,
                      type="text")))
    body = obj(contents=contents, layout="vertical", paddingAll="20px", spacing="md",
               type="box")
    return flex_message(SUMMARY_ALT_TEXT, obj(body=body, header=header, size="mega",
                                              type="bubble"))


def summary_bubbles(df: DataFrame, text_col: str, keys, run_date: str) -> DataFrame:
    return df.select(*keys, summary_bubble(_c(text_col), run_date).alias("message"))


# O28–O30 -----------------------------------------------------------------------
def push_envelope(to, message) -> Column:
    return F.to_json(F.named_struct(F.lit("to"), _c(to), F.lit("messages"), F.array(_c(message))))


def reply_envelope(reply_token, message) -> Column:
    # The platform's field is replyToken (the reference wrote reply_token).
    return F.to_json(F.named_struct(F.lit("replyToken"), _c(reply_token),
                                    F.lit("messages"), F.array(_c(message))))


def broadcast_envelope(message) -> Column:
    return F.to_json(F.named_struct(F.lit("messages"), F.array(_c(message))))


def outbox_push(df: DataFrame, user_col: str = "user_id", message_col: str = "message",
                keys=()) -> DataFrame:
    """One push envelope per (recipient, message) row."""
    return df.select(*keys, F.lit("push").alias("channel"), F.col(user_col).alias("recipient"),
                     push_envelope(user_col, message_col).alias("payload"))


def outbox_reply(df: DataFrame, token_col: str = "reply_token", message_col: str = "message",
                 keys=()) -> DataFrame:
    return df.select(*keys, F.lit("reply").alias("channel"), F.col(token_col).alias("recipient"),
                     reply_envelope(token_col, message_col).alias("payload"))


def outbox_broadcast(df: DataFrame, message_col: str = "message", keys=()) -> DataFrame:
    """One broadcast envelope per message; the platform fans it out to all
    followers, so no recipient list is joined in (no cross product)."""
    return df.select(*keys, F.lit("broadcast").alias("channel"),
                     F.lit(None).cast("string").alias("recipient"),
                     broadcast_envelope(message_col).alias("payload"))


# O31 -------------------------------------------------------------------------
#: outcome of an outbox row before it is sent
READY, ERROR, REJECTED, NEEDS_TRANSLATION = "ready", "error", "rejected", "needs_translation"


def outbox_sink(outbox: DataFrame, path: str, job: str, run_date: str) -> None:
    """Durable outbox in place of the HTTP POST: parquet by run date and job.

    Every row keeps its outcome (``status``; rows without one are ready).
    ``partitionOverwriteMode=dynamic`` makes a rerun replace only the
    partition of its own job and date, so a retried job never doubles rows
    and jobs that share a channel keep each other's.
    """
    if "status" not in outbox.columns:
        outbox = outbox.withColumn("status", F.lit(READY))
    (outbox.withColumn("run_date", F.lit(run_date)).withColumn("job", F.lit(job))
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy("run_date", "job").parquet(path))
