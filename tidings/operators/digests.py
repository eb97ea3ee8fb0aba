"""J2 — digests, selection by index, URL and language predicates (O07–O13).

A feed's stories travel as one array (they come from one row), so digests are
rendered in the row; a selection is one join of the request to its feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.text import SECTION_BREAK
from tidings.functions.url import is_valid_url, url_host
from tidings.session import materialize

# Digest line format "{rank}. {title} {link}", the headline
# format, and the reference's error texts.
TEXT_NO_VALID_SELECTION = "No valid stories selected"
TEXT_NO_TITLE = "No title found"
TEXT_NO_LINK = "No link found"
TEXT_NO_STORIES = "No stories found"
TEXT_FETCH_FAILED = "Failed to fetch RSS feed"
TEXT_PARSE_FAILED = "Failed to parse RSS"
TEXT_NETWORK = "Network error while fetching RSS feed"
NO_TRANSLATION = ("en", "zh-tw")


def digest_line(rank, story, link):
    return F.concat(rank.cast("string"), F.lit(". "), story, F.lit(" "), link)


def digest_text(stories: Column) -> Column:
    """"{rank}. {title} {link}" lines of a story array joined by a blank line."""
    lines = F.transform(stories, lambda s, i: digest_line(i + 1, s["story"], s["storylink"]))
    return F.array_join(lines, SECTION_BREAK)


def rows_where(df: DataFrame, keep: Column, *columns) -> DataFrame:
    """The columns of the rows where ``keep`` holds, by exploding a 0/1 array:
    a filter would be pushed down and evaluate its expression once more."""
    return df.select(F.inline(F.slice(F.array(F.struct(*columns)), 1, F.when(keep, 1).otherwise(0))))


# O07 -------------------------------------------------------------------------
def story_rank(stories: DataFrame) -> DataFrame:
    """Rank (1-based, document order, from the extraction) and its card label."""
    return stories.select("feed_id", "rank",
                          F.concat(F.lit("#"), F.col("rank").cast("string")).alias("rank_label"),
                          "story")


# O08 -------------------------------------------------------------------------
def story_digest(feeds: DataFrame, keys=("feed_id",)) -> DataFrame:
    """(keys…, stories) -> (keys…, n_stories, digest), feeds with stories only."""
    n = F.size("stories")
    return rows_where(feeds, n > 0, *keys, n.cast("bigint").alias("n_stories"),
                      digest_text(F.col("stories")).alias("digest"))


# O09 / O10 ---------------------------------------------------------------------
#: requests of a feed beyond this share of a task's fair part go to another salt; small
#: parts, as salts fall on tasks by hash
HOT_SHARE = 0.125


def request_salts(selections: DataFrame) -> DataFrame:
    """(feed_id, salts): hot feeds and over how many keys their requests are dealt.

    A feed is hot when its requests pass HOT_SHARE of a fair task's part; so there
    are at most tasks / HOT_SHARE such feeds, which bounds the table.
    """
    tasks = int(selections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = materialize(selections.groupBy("feed_id").agg(F.count(F.lit(1)).alias("n")))  # counted in the map tasks first
    total = counts.agg(F.sum("n")).first()[0] or 0
    fair = max(HOT_SHARE * total / tasks, 1.0)
    salts = F.ceil(F.col("n") / F.lit(fair)).cast("int")
    return counts.where((F.col("n") > fair) & F.col("feed_id").isNotNull()).select("feed_id", salts.alias("salts"))


def picked_stories(selections: DataFrame, feeds: DataFrame) -> DataFrame:
    """Every request with the array of its valid picks, in request order.

    Indexes are 1-based into the feed's story array; those outside it are
    dropped, duplicates stay.  One join on the feed, where the requests of hot
    feeds are dealt over salts and the arrays of these feeds repeated for them.
    """
    hot = F.broadcast(request_salts(selections))  # eight times the tasks at most
    every = F.xxhash64(*selections.columns)
    dealt = (selections.join(hot, "feed_id", "left")
                       .select(*selections.columns, F.coalesce(F.pmod(every, F.col("salts")).cast("int"), F.lit(0)).alias("_salt")))
    known = (feeds.join(hot, "feed_id", "left")
                  .select("feed_id", F.col("stories").alias("_all"),
                          F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("_salt")))
    pick = lambda i: F.when(i > 0, F.get(F.col("_all"), (i - 1).cast("int")))
    picks = F.filter(F.transform("indexes", pick), lambda s: s.isNotNull())
    return (dealt.join(known, ["feed_id", "_salt"], "left")
                 .select(*selections.columns, picks.alias("stories")))


def select_stories(selections: DataFrame, feeds: DataFrame) -> DataFrame:
    """Accepted requests with the renumbered digest of their picks."""
    n = F.size("stories")
    return rows_where(picked_stories(selections, feeds), n > 0, "request_id", "feed_id", "user_id", "language_code",
                      n.cast("bigint").alias("n_selected"), digest_text(F.col("stories")).alias("digest"))


def selection_status(selections: DataFrame, feeds: DataFrame) -> DataFrame:
    """Every request: accepted, or a validation error when no index is valid."""
    n = F.greatest(F.size("stories"), F.lit(0))  # no such feed: no stories
    ok = n > 0
    return picked_stories(selections, feeds).select(
        "request_id",
        F.when(ok, "accepted").otherwise("rejected").alias("status"),
        n.cast("bigint").alias("n_selected"),
        F.when(~ok, "validation").alias("error_class"),
        F.when(~ok, TEXT_NO_VALID_SELECTION).alias("error_text"))


# O11 -------------------------------------------------------------------------
def headline(title: Column, link: Column) -> Column:
    return F.concat(F.lit("Latest story: "), title, F.lit("\n"), link)


def latest_headline(latest: DataFrame) -> DataFrame:
    """First item -> "Latest story: {title}\\n{link}"; null title/link -> error."""
    err = (F.when(F.col("title").isNull(), TEXT_NO_TITLE)
            .when(F.col("link").isNull(), TEXT_NO_LINK))
    return latest.select("feed_id", F.when(err.isNull(), headline(F.col("title"), F.col("link"))).alias("text"),
                         err.alias("error_text"))


def feed_headlines(feeds: DataFrame) -> DataFrame:
    """O11 over feed bodies: one row per feed, the newest item's headline or
    the reference's error (network, fetch or parse failure, no item, no
    title, no link).  Narrow: the first item is read from the parsed body."""
    from tidings.operators.feeds import first_items
    f, first = F.col("failure"), F.col("first")
    err = (F.when(f == "network_error", TEXT_NETWORK).when(f == "http_error", TEXT_FETCH_FAILED)
            .when(f == "parse_error", TEXT_PARSE_FAILED)
            .when(first.isNull(), TEXT_NO_STORIES)
            .when(first["title"].isNull(), TEXT_NO_TITLE)
            .when(first["link"].isNull(), TEXT_NO_LINK))
    s = first_items(feeds).select("feed_id", err.alias("error_text"), "first.title", "first.link")
    return s.select("feed_id", F.when(F.col("error_text").isNull(), headline(F.col("title"), F.col("link"))).alias("text"),
                    "error_text")


# O12 -------------------------------------------------------------------------
def valid_urls(urls: DataFrame) -> DataFrame:
    """Flag each URL: http/https with a host; keep the host when valid."""
    return urls.select("request_id", "url", is_valid_url("url").alias("is_valid"),
                       url_host("url").alias("host"))


# O13 -------------------------------------------------------------------------
def needs_translation(lang_col="language_code"):
    """Case-sensitive, untrimmed: anything but 'en' and 'zh-tw'."""
    c = F.col(lang_col) if isinstance(lang_col, str) else lang_col
    return ~c.isin(*NO_TRANSLATION)


def translate_queue(rows: DataFrame, lang_col: str = "language_code") -> DataFrame:
    return rows.where(needs_translation(lang_col))
