"""J1 — feed and link mart (O01–O06).

Feed bodies are parsed once with ``from_xml``; the newest item is the first
item *in document order*, so O02/O04/O06 need no shuffle.  Story links come
from one pass over the tags of the item's description, keeping anchor order,
dropping anchors without ``href`` and joining all nested text of an anchor.

A feed whose ``http_status`` is null never answered (network failure); a
status outside 2xx fails before parsing.  An empty ``<title></title>`` is a
title (``''``); only an absent one is "not found".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.html import Scope, link_array

CHANNEL_SCHEMA = ("channel struct<title:string,"
                  "item:array<struct<title:string,link:string,description:string>>>")
XML_OPTIONS = {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}

# Error texts of the reference's feed routes.
TEXT_STORIES_ERROR = "RSS feed service error or parsing failed"
TEXT_STORIES_NETWORK = "Network error while fetching RSS feed"
TEXT_TITLE_ERROR = "RSS feed service unavailable or invalid format"
TEXT_TITLE_NOT_FOUND = "No title found"

NAV = Scope("nav")


def parse_channel(body: Column) -> Column:
    """Feed body text -> channel struct (null when the XML does not parse)."""
    return F.from_xml(body, CHANNEL_SCHEMA, XML_OPTIONS)["channel"]


def fetched() -> Column:
    """Whether the feed answered with a success; null status is a network failure."""
    return F.coalesce(F.col("http_status").between(200, 299), F.lit(False))


def fetched_channel() -> Column:
    return F.when(fetched(), parse_channel(F.col("body")))


def first_items(feeds: DataFrame) -> DataFrame:
    """(feed_id, failure, first): the newest item, or why there is no channel
    (``network_error``, ``http_error``, ``parse_error``)."""
    parsed = feeds.select("feed_id", "http_status", fetched_channel().alias("ch"))
    failure = (F.when(F.col("http_status").isNull(), "network_error").when(~fetched(), "http_error")
                .when(F.col("ch").isNull(), "parse_error"))
    return parsed.select("feed_id", failure.alias("failure"),
                         F.try_element_at(F.col("ch")["item"], F.lit(1)).alias("first"))


def _explode_links(df: DataFrame, keys: list[str], links: Column) -> DataFrame:
    return (df.select(*keys, F.posexplode(links).alias("pos", "l"))
              .select(*keys, (F.col("pos") + 1).cast("bigint").alias("rank"),
                      F.col("l.storylink").alias("storylink"),
                      F.col("l.story").alias("story")))


# O01 -------------------------------------------------------------------------
def feed_items(feeds: DataFrame) -> DataFrame:
    """Feed bodies -> one row per item, in document order (item_no from 1)."""
    # exploding the expression itself: from a projected column the optimizer
    # infers a filter on its size, which would parse every body twice
    return (feeds.select("feed_id", F.posexplode(fetched_channel()["item"]).alias("pos", "it"))
                  .select("feed_id", (F.col("pos") + 1).cast("bigint").alias("item_no"),
                          F.col("it.title").alias("title"),
                          F.col("it.link").alias("link"),
                          F.col("it.description").alias("description")))


# O02 -------------------------------------------------------------------------
def latest_item(feeds: DataFrame) -> DataFrame:
    """First item of each feed by document order (not by date); narrow."""
    # inline of a one-element slice: no row for an empty feed, and no filter
    # that the optimizer would push down and evaluate (parse) a second time
    first = F.slice(fetched_channel()["item"], 1, 1)
    return feeds.select("feed_id", F.inline(first))


# O03 -------------------------------------------------------------------------
def extract_links(df: DataFrame, html_col: str = "html", keys=("page_id",),
                  scope: Scope = NAV) -> DataFrame:
    """HTML rows -> (keys…, rank, storylink, story), anchors in order."""
    return _explode_links(df, list(keys), link_array(F.col(html_col), scope))


def page_stories(pages: DataFrame, scope: Scope = NAV) -> DataFrame:
    """Stories of every page, the page being the feed: (feed_id, rank, …)."""
    return extract_links(pages.select(F.col("page_id").alias("feed_id"), "html"),
                         "html", ("feed_id",), scope)


def page_story_arrays(pages: DataFrame, scope: Scope = NAV) -> DataFrame:
    """(feed_id, stories): every page's stories as one array, in order."""
    return with_story_arrays(pages, scope).select(F.col("page_id").alias("feed_id"), "stories")


def with_story_arrays(pages: DataFrame, scope: Scope = NAV) -> DataFrame:
    """``pages`` with the stories of each as one array, in order."""
    return pages.withColumn("stories", link_array(F.col("html"), scope))


def stories_of(arrays: DataFrame) -> DataFrame:
    """(feed_id, stories) -> the rows of ``page_stories``, without looking at the HTML again."""
    # an identity transform keeps the optimizer from inferring (and pushing
    # down) a filter on the array's size, which would parse every body twice
    return _explode_links(arrays, ["feed_id"], F.transform("stories", lambda s: s))


# O04 -------------------------------------------------------------------------
def feed_stories(feeds: DataFrame, scope: Scope = NAV) -> DataFrame:
    """(feed_id, status, stories): the newest item's stories as one array, or
    the reason why there are none.  One parse of the body and of the HTML."""
    s = first_items(feeds).select("feed_id", "failure", "first.description")
    s = s.select("feed_id", "failure", F.col("description").isNull().alias("bare"),
                 link_array(F.col("description"), scope).alias("stories"))
    status = (F.when(F.col("failure").isNotNull(), F.col("failure")).when(F.col("bare"), "no_description")
               .when(F.size("stories") == 0, "no_links").otherwise("ok"))
    return s.select("feed_id", status.alias("status"), "stories")


def latest_stories(feeds: DataFrame, scope: Scope = NAV) -> DataFrame:
    """Story links of each feed's newest item: (feed_id, rank, storylink, story)."""
    return stories_of(feed_stories(feeds, scope))


# O05 -------------------------------------------------------------------------
def feed_error(status: Column, network: str, external: str) -> Column:
    """A route's error text for a feed status, null for 'ok'."""
    return F.when(status == "network_error", network).when(status != "ok", external)


def feed_status(feeds: DataFrame, scope: Scope = NAV) -> DataFrame:
    """One row per feed: status, error class and text, story count."""
    status = F.col("status")
    return feed_stories(feeds, scope).select(
        "feed_id", "status", F.size("stories").cast("bigint").alias("n_stories"),
        F.when(status == "network_error", "network").when(status != "ok", "external").alias("error_class"),
        feed_error(status, TEXT_STORIES_NETWORK, TEXT_STORIES_ERROR).alias("error_text"))


# O06 -------------------------------------------------------------------------
def latest_title(feeds: DataFrame) -> DataFrame:
    """Newest item's title; no item or no title -> not found (404)."""
    f, title = F.col("failure"), F.col("first.title")
    return first_items(feeds).select(
        "feed_id", title.alias("title"), (f.isNull() & title.isNotNull()).alias("success"),
        F.when(f.isNotNull(), 500).when(title.isNull(), 404).otherwise(200).alias("http_code"),
        F.when(f == "network_error", TEXT_STORIES_NETWORK).when(f.isNotNull(), TEXT_TITLE_ERROR)
         .when(title.isNull(), TEXT_TITLE_NOT_FOUND).alias("error_text"))
