"""J3 — enrichment as offline tables (O14–O22).

The reference asks remote models for summaries, language codes and
translations.  Here the request bodies (O14, O15) and the reply parsing
(O16, O17) are exact; the pairing with a default (O18) is exact; and the
model work itself is re-aimed as plain corpus statistics computed by Spark:
extractive summaries (O20–O22) and a word-profile language guesser (O19).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.text import (CHINESE, SECTION_BREAK, has_kana, language_terms, let, letter_words, most_frequent,
                                    script_language, truncate_chars, unicode_trim)

# The reference's fallback summary text.
DEFAULT_SUMMARY = "摘要生成失敗"

SENTENCE_RE = r"[^.!?。！？\n]+[.!?。！？]*"
#: sentences are linked by those of their text's most frequent words that they share
KEYWORDS = 20
#: steps of the power iteration over that graph; weights are whole numbers up to WEIGHT_TOP
POWER_STEPS = 2
WEIGHT_TOP = 1000


# O20 -------------------------------------------------------------------------
def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("bigint"), lambda a, v: a + v)


def _worth(places: Column, weights: Column) -> Column:
    """Sum of the weights of a sentence's keywords."""
    return _total(F.transform(places, lambda j: F.get(weights, j)))


def _power_step(sentences: Column, weights: Column) -> Column:
    """Keyword weights after one step: every sentence gives its worth to its keywords.

    This is a step of the power iteration with the matrix of shared keywords of
    every two sentences, in its factored form: linear in the sentences.
    """
    holds = lambda p: F.aggregate(p, F.lit(0), lambda a, j: a.bitwiseOR(F.call_function("shiftleft", F.lit(1), j)))
    scored = F.transform(sentences, lambda p: F.struct(holds(p).alias("bits"), _worth(p, weights).alias("worth")))

    def gathered(x: Column) -> Column:
        each = F.transform(weights, lambda _, j: F.aggregate(
            x, F.lit(0).cast("bigint"), lambda a, v: a + F.getbit(v["bits"], j) * v["worth"]))
        return let(each, lambda w: let(F.array_max(w), lambda top: F.transform(
            w, lambda v: F.call_function("div", v * WEIGHT_TOP, top))))
    return let(scored, gathered)


def _picks(sentences: Column, weights: Column, top_k: int) -> Column:
    """Indexes of the chosen sentences in text order: ``top_k`` times the one of
    the most worth (ties by position), whose keywords then weigh nothing."""
    def pick(state: Column, _: Column) -> Column:
        gain = F.transform(sentences, lambda p, i: F.struct((-_worth(p, state["w"])).alias("less"), i.alias("no")))

        def take(best: Column) -> Column:
            left = F.transform(state["w"], lambda v, j: F.when(F.array_contains(F.get(sentences, best["no"]), j), 0).otherwise(v))
            return F.when(best["less"] < 0, F.struct(left.alias("w"), F.concat(state["picks"], F.array(best["no"])).alias("picks"))
                          ).otherwise(state)
        return let(F.array_min(gain), take)

    start = F.struct(weights.alias("w"), F.array().cast("array<int>").alias("picks"))
    return F.sort_array(F.aggregate(F.sequence(F.lit(1), F.lit(top_k)), start, pick, lambda x: x["picks"]))


def summary_of(text: Column, top_k: int = 3, max_chars: int = 100) -> Column:
    """Extractive summary of one text from that text alone; null without a sentence.

    A graph of the sentences: two are as similar as the number of the text's
    ``KEYWORDS`` most frequent words that they share.  ``POWER_STEPS`` steps of
    the power iteration weigh the keywords.  Then up to ``top_k`` sentences are
    taken by the weight of their keywords that no sentence taken before holds,
    so a repeated sentence is not taken twice and one that adds nothing is left
    out.  They are rejoined in text order and cut to ``max_chars``.  Everything
    happens in the row with whole numbers: no shuffle, and a summary does not
    change when other rows do.
    """
    def best(s: Column, ws: Column, keywords: Column) -> Column:
        places = F.transform(ws, lambda w: F.transform(
            F.array_intersect(w, keywords), lambda x: (F.array_position(keywords, x) - 1).cast("int")))

        def chosen(p: Column, weights: Column, steps: int) -> Column:
            if not steps:
                return _picks(p, weights, top_k)
            return let(_power_step(p, weights), lambda w: chosen(p, w, steps - 1))
        equal = F.transform(keywords, lambda _: F.lit(1).cast("bigint"))
        picks = let(places, lambda p: let(equal, lambda w: chosen(p, w, POWER_STEPS)))
        cut = lambda x: F.array_join(F.transform(x, lambda i: unicode_trim(F.get(s, i))), " ")
        return let(picks, lambda x: F.when(F.size(x) > 0, truncate_chars(cut(x), max_chars)))

    # sentences without a letter have no words, so they are never taken
    return let(F.regexp_extract_all(text, F.lit(SENTENCE_RE), 0), lambda s: let(F.transform(s, letter_words), lambda ws: let(
        most_frequent(F.flatten(ws), KEYWORDS), lambda k: best(s, ws, k))))


def extract_summary(docs: DataFrame, keys, text_col: str = "text", top_k: int = 3,
                    max_chars: int = 100) -> DataFrame:
    """(keys…, summary) of the texts that hold a sentence; no shuffle."""
    summary = F.filter(F.array(summary_of(F.col(text_col), top_k, max_chars)), lambda s: s.isNotNull())
    return docs.select(*keys, F.explode(summary).alias("summary"))


# O18 -------------------------------------------------------------------------
def enrich_with_default(stories: DataFrame, results: DataFrame, keys=("feed_id", "rank"),
                        default: str = DEFAULT_SUMMARY) -> DataFrame:
    """Pair every story with its summary; a missing or failed one gets the
    default text and ``failed = true``.  Order columns are kept."""
    keys = list(keys)
    r = results.select(*keys, F.col("summary").alias("_summary"))
    j = stories.join(r, keys, "left")
    return j.select(*stories.columns,
                    F.coalesce("_summary", F.lit(default)).alias("summary"),
                    F.col("_summary").isNull().alias("failed"))


def story_summaries(stories: Column, default: str = DEFAULT_SUMMARY) -> Column:
    """Story array -> the same array with rank and stand-in summary (the title's
    own extract, or the default text when it has no sentence)."""
    return F.transform(stories, lambda s, i: F.struct(
        (i + 1).cast("bigint").alias("rank"), s["storylink"].alias("storylink"), s["story"].alias("story"),
        F.coalesce(summary_of(s["story"]), F.lit(default)).alias("summary")))


def enrich_arrays(feeds: DataFrame, results: DataFrame, default: str = DEFAULT_SUMMARY) -> DataFrame:
    """(feed_id, stories, …) with each story's landed summary, or the default.

    ``results`` (feed_id, rank, summary) is gathered per feed, as many values
    as the feed has stories, and joined once.
    """
    landed = (results.groupBy("feed_id")
                     .agg(F.map_from_entries(F.collect_list(F.struct("rank", "summary"))).alias("_landed")))
    paired = F.transform("stories", lambda s, i: F.struct(
        (i + 1).cast("bigint").alias("rank"), s["storylink"].alias("storylink"), s["story"].alias("story"),
        F.coalesce(F.try_element_at("_landed", (i + 1).cast("bigint")), F.lit(default)).alias("summary")))
    others = [c for c in feeds.columns if c != "stories"]
    return feeds.join(landed, "feed_id", "left").select(*others, paired.alias("stories"))


# O21 -------------------------------------------------------------------------
def highlight_of(stories: Column, n_keywords: int = 3) -> Column:
    """Struct (top_rank, keywords, highlight) of one story array, in the row.

    Keywords are the ``n_keywords`` most frequent title words (ties by word);
    the top story has most keyword hits (ties by rank).  The text's sections:
    the top story, the keywords if there are any, then the digest.
    """
    from tidings.operators.digests import digest_line, digest_text

    def render(titles: Column, keywords: Column) -> Column:
        hits = lambda ws, i: F.struct(
            (-F.size(F.filter(ws, lambda w: F.array_contains(keywords, w)))).alias("less"), (i + 1).alias("rank"))
        rank = F.get(F.sort_array(F.transform(titles, hits)), F.lit(0))["rank"]
        top = lambda r: F.get(stories, r - 1)
        listed = F.array_join(keywords, ", ")
        return let(rank, lambda r: F.struct(
            r.cast("bigint").alias("top_rank"), listed.alias("keywords"),
            F.concat_ws(SECTION_BREAK,
                        F.concat(F.lit("Top story: "), digest_line(r, top(r)["story"], top(r)["storylink"])),
                        F.when(listed != "", F.concat(F.lit("Keywords: "), listed)),
                        digest_text(stories)).alias("highlight")))

    titles = F.transform(stories, lambda s: letter_words(s["story"]))
    return let(titles, lambda t: let(most_frequent(F.flatten(t), n_keywords), lambda k: render(t, k)))


def digest_highlights(feeds: DataFrame, keys=("feed_id",), n_keywords: int = 3) -> DataFrame:
    """(keys…, stories) -> (keys…, top_rank, keywords, highlight) of feeds with stories."""
    h = F.slice(F.array(highlight_of(F.col("stories"), n_keywords)), 1, F.when(F.size("stories") > 0, 1).otherwise(0))
    return feeds.select(*keys, F.inline(h))


# O14 -------------------------------------------------------------------------
# The reference's prompts, model names and sampling settings.
PROMPT_SUMMARY_ALL = ("這是今日的 Hacker News 前十大新聞，以綜合分析的方式進行概括，並條列出各新聞的主要重點。"
                      "同時，請將各項新聞中最重要的一項與其相關的關鍵字突顯出來。最後，請以適當的段落劃分，"
                      "並以('\n\n')作為分段符號。always response in zh-tw: ")
PROMPT_SUMMARY_SINGLE = "請用2-3句話簡潔摘要這則 Hacker News 新聞的重點。不要超過100字。always response in zh-tw: "
PROMPT_LANGUAGE = ("identify the input is which language, and response it only to ISO 639-1 standard "
                   "language codes and country code without any more explaination, if input is Chinese, "
                   "always return zh-tw: ")
PROMPT_TRANSLATE = "translate to "
MODEL = "gpt-4o"
TRANSLATE_MODEL = "gpt-3.5-turbo"
MAX_TOKENS = 2048
TASKS = [  # task, prompt, model, temperature
    ("summary_all", PROMPT_SUMMARY_ALL, MODEL, 0.05),
    ("summary_single", PROMPT_SUMMARY_SINGLE, MODEL, 0.05),
    ("get_language_code", PROMPT_LANGUAGE, MODEL, 0.0),
    ("translate", PROMPT_TRANSLATE, TRANSLATE_MODEL, 0.05),
]
URL_ENGINE = "agnes"
URL_TARGET_LANGUAGE = "EN"


def tasks_table(spark) -> DataFrame:
    """The four prompted tasks (configuration, 4 rows)."""
    return spark.createDataFrame(TASKS, "task string, prompt string, model string, temperature double")


def inference_requests(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """(key, task, content) -> (key, task, model, body): one chat request
    body per row, prompt + one space + content, fields in the reference's
    declaration order.  The planner broadcasts the task table by its size."""
    j = requests.join(tasks, "task")
    msg = F.named_struct(F.lit("role"), F.lit("user"), F.lit("content"),
                         F.concat(F.col("prompt"), F.lit(" "), F.col("content")))
    body = F.to_json(F.named_struct(
        F.lit("model"), F.col("model"), F.lit("messages"), F.array(msg),
        F.lit("temperature"), F.col("temperature"), F.lit("max_tokens"), F.lit(MAX_TOKENS),
        F.lit("top_p"), F.lit(1.0), F.lit("frequency_penalty"), F.lit(0.0),
        F.lit("presence_penalty"), F.lit(0.0)))
    return j.select("key", "task", "model", body.alias("body"))


def translate_content(lang_col: str, text_col: str):
    """Content of a translate request: "{lang}: {text}"."""
    return F.concat(F.col(lang_col), F.lit(": "), F.col(text_col))


# O15 -------------------------------------------------------------------------
def url_summary_requests(urls: DataFrame) -> DataFrame:
    """Valid URLs -> summarizer request body (sorted keys)."""
    from tidings.functions.url import is_valid_url
    body = F.to_json(F.named_struct(F.lit("engine"), F.lit(URL_ENGINE),
                                    F.lit("target_language"), F.lit(URL_TARGET_LANGUAGE),
                                    F.lit("url"), F.col("url")))
    return urls.where(is_valid_url("url")).select("request_id", "user_id", body.alias("body"))


# O16 -------------------------------------------------------------------------
def _i32(v):
    from tidings.functions.jsonfn import is_vint
    x = F.try_variant_get(v, "$", "bigint")
    return is_vint(v) & x.between(-2147483648, 2147483647)


def inference_results(replies: DataFrame, keys=("key",)) -> DataFrame:
    """(keys…, http_status, body) -> (keys…, status, content): the first
    choice's content; no choice -> ai_error; bad JSON, trailing text or a
    missing/mistyped required field -> serialization_error; HTTP not 2xx ->
    external_error."""
    from tidings.functions.jsonfn import is_varray, is_vint, is_vobject, is_vstring, vfield
    from tidings.operators.webhooks import strict_json
    replies = replies.select(*keys, "http_status", strict_json(F.col("body")).alias("_v"))
    v = F.col("_v")
    usage = vfield(v, "$.usage")
    choices = vfield(v, "$.choices")
    carr = F.try_variant_get(choices, "$", "array<variant>")

    def choice_ok(ch):
        m = vfield(ch, "$.message")
        return (is_vobject(ch) & is_vobject(m) & is_vstring(vfield(m, "$.role"))
                & is_vstring(vfield(m, "$.content")) & is_vstring(vfield(ch, "$.finish_reason"))
                & _i32(vfield(ch, "$.index")))

    shape = F.coalesce(
        is_vobject(v) & is_vstring(vfield(v, "$.id")) & is_vstring(vfield(v, "$.object"))
        & is_vint(vfield(v, "$.created")) & is_vstring(vfield(v, "$.model"))
        & is_vobject(usage) & _i32(vfield(usage, "$.prompt_tokens"))
        & _i32(vfield(usage, "$.completion_tokens")) & _i32(vfield(usage, "$.total_tokens"))
        & is_varray(choices) & F.forall(carr, choice_ok), F.lit(False))
    status = (F.when(~F.col("http_status").between(200, 299), "external_error")
               .when(~shape, "serialization_error")
               .when(F.size(carr) == 0, "ai_error").otherwise("ok"))
    content = F.try_variant_get(v, "$.choices[0].message.content", "string")
    return replies.select(*keys, status.alias("status"),
                          F.when(status == "ok", content).alias("content"))


# O17 -------------------------------------------------------------------------
def url_summary_results(replies: DataFrame, keys=("key",)) -> DataFrame:
    """Summarizer replies -> (keys…, status, summary); checks in the
    reference's order: HTTP status, JSON shape, ``error`` set, no ``data``."""
    from tidings.functions.jsonfn import (is_vnull_or_absent, is_vnumber, is_vobject,
                                          is_vstring, vfield)
    from tidings.operators.webhooks import strict_json

    def opt(x, pred):
        return is_vnull_or_absent(x) | pred(x)

    replies = replies.select(*keys, "http_status", strict_json(F.col("body")).alias("_v"))
    v = F.col("_v")
    meta, data = vfield(v, "$.meta"), vfield(v, "$.data")
    data_ok = opt(data, lambda d: is_vobject(d) & is_vstring(vfield(d, "$.summary"))
                  & opt(vfield(d, "$.tokens"), _i32))
    shape = F.coalesce(
        is_vobject(v) & is_vobject(meta) & is_vstring(vfield(meta, "$.id"))
        & opt(vfield(meta, "$.node"), is_vstring) & is_vnumber(vfield(meta, "$.timing"))
        & opt(vfield(meta, "$.info"), is_vstring) & data_ok
        & opt(vfield(v, "$.error"), is_vstring), F.lit(False))
    has_error = ~is_vnull_or_absent(vfield(v, "$.error"))
    status = (F.when(~F.col("http_status").between(200, 299), "external_error")
               .when(~shape, "serialization_error")
               .when(has_error, "external_error")
               .when(is_vnull_or_absent(data), "external_error")
               .otherwise("ok"))
    summary = F.try_variant_get(v, "$.data.summary", "string")
    return replies.select(*keys, status.alias("status"),
                          F.when(status == "ok", summary).alias("summary"))


# O19 -------------------------------------------------------------------------
FALLBACK_LANGUAGE = "en"


def _known_as(lang: Column) -> Column:
    """All Chinese labels are one language."""
    return F.when(F.lower(lang).rlike(r"^zh\b"), CHINESE).otherwise(lang)


def _most_of(rows: DataFrame, keys, value: str) -> DataFrame:
    """(keys…, value): each key's most frequent value (ties by the smaller one), null without any.

    Rows are counted by key and value first, in a hash table and in the map tasks; one row per value is left to compare.
    """
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col("_n")).alias("less"), F.col(value).alias("value"))))
    return counts.groupBy(*keys).agg(best.alias("_best")).select(*keys, F.col("_best.value").alias(value))


def language_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", by=()) -> DataFrame:
    """(by…, word, lang): every term with the label most of its texts have
    (ties by the smaller label)."""
    known = labelled.select(*by, _known_as(F.col(lang_col)).alias("lang"), F.col(text_col).alias("_words_of"))
    terms = known.select(*by, "lang", F.explode(language_terms("_words_of")).alias("word"))
    return _most_of(terms, [*by, "word"], "lang").where(F.col("lang").isNotNull()).select(*by, "word", "lang")


def detect_language(texts: DataFrame, profiles: DataFrame, keys, text_col: str = "text", by=(),
                    default: str = FALLBACK_LANGUAGE) -> DataFrame:
    """(keys…, language): the label that most distinct terms of the text vote
    for (ties by the smaller label); no vote -> ``default``.

    A term that no labelled text holds votes by its script, where that stands
    for one language.  Only ``keys`` and one term at a time travel to the
    join; a term occurs once per text, so even the hottest one has one row per
    text, and AQE splits it when ``profiles`` is a landed table.
    """
    keys = list(keys)
    # in a step of its own, below the explode: beside it, the whole text would be searched once per term
    marked = texts.select(*keys, *[b for b in by if b not in keys], has_kana(text_col).alias("_kana"),
                          F.col(text_col).alias("_words_of"))
    votes = marked.select(*[c for c in marked.columns if c != "_words_of"], F.explode_outer(language_terms("_words_of")).alias("word"))
    known = votes.join(profiles.select(*by, "word", F.col("lang").alias("_vote")), [*by, "word"], "left")
    vote = F.coalesce("_vote", script_language(F.col("word"), F.col("_kana")))
    best = _most_of(known.select(*keys, vote.alias("_lang")), keys, "_lang")
    return best.select(*keys, F.coalesce("_lang", F.lit(default)).alias("language"))


def with_language(events: DataFrame, profiles: DataFrame, id_col: str = "webhook_id", text_col: str = "text") -> DataFrame:
    """``events`` with the language of their text, null where there is none.

    The guess is made per id and text hash, so the text stays out of the word
    join, and repeated rows of an id keep their number.
    """
    marked = events.withColumn("_text", F.xxhash64(text_col))
    asked = marked.where(F.col(text_col).isNotNull()).select(id_col, "_text", text_col)
    guessed = detect_language(asked, profiles, [id_col, "_text"], text_col)
    return marked.join(guessed, [id_col, "_text"], "left").select(*events.columns, "language")


# O22 -------------------------------------------------------------------------
DROP_BLOCKS_RE = (r"(?is)<!--.*?-->|<head\b.*?</head\s*>|<script\b.*?</script\s*>"
                  r"|<style\b.*?</style\s*>|<nav\b.*?</nav\s*>")
BREAK_TAGS_RE = r"(?i)<br\s*/?>|</(?:p|h[1-6]|div|li|article|section|footer|header|tr)\s*>"


def page_text(html_col: str = "html"):
    """Readable text of a page: drop comments, head, scripts, styles and
    navigation; block ends become line breaks; tags dropped; entities decoded."""
    from tidings.functions.text import html_unescape, strip_tags
    t = F.regexp_replace(F.col(html_col), DROP_BLOCKS_RE, " ")
    t = F.regexp_replace(t, BREAK_TAGS_RE, "\n")
    return html_unescape(strip_tags(t))


def page_extract(pages: DataFrame, keys=("page_id",), top_k: int = 3, max_chars: int = 200) -> DataFrame:
    """Extractive summary of each landed page (no fetch): (keys…, summary)."""
    return extract_summary(pages.select(*keys, page_text("html").alias("text")), keys, "text", top_k, max_chars)
