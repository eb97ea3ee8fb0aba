"""Feed sources: landed RSS files, or feed bodies derived from ``pages``.

A landed feed is one RSS document.  ``read_feed_files`` reads a folder of
them as bodies, one row each; ``landed_items`` and ``landed_status`` read them
item by item, so that a large file is read by several tasks and no row holds
it whole.  For the test tables every page is a feed: its newest item is the page
itself (title, URL, HTML as description) and its older items are the page's
links, all built in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidings.functions.html import Scope, link_array
from tidings.functions.text import html_unescape, xml_escape
from tidings.session import materialize

TITLE_RE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"


def page_title(html: str = "html") -> Column:
    """Decoded title of a page; null without a title element, '' for an empty one."""
    c = F.col(html)
    return F.when(c.rlike(TITLE_RE), html_unescape(F.regexp_extract(c, TITLE_RE, 1)))


def element(name: str, text: Column) -> Column:
    """An XML element, or '' for a null text."""
    return F.coalesce(F.concat(F.lit(f"<{name}>"), xml_escape(text), F.lit(f"</{name}>")), F.lit(""))


def item(title: Column, link: Column, description: Column) -> Column:
    return F.concat(F.lit("<item>"), element("title", title), element("link", link),
                    element("description", description), F.lit("</item>"))


def rss_body(title: Column, items: Column) -> Column:
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel>'),
                    element("title", title), items, F.lit("</channel></rss>"))


def page_body(links: Column | None = None) -> Column:
    """RSS body of a page: the page as newest item, its links (``links``, if found already) as older ones."""
    none = F.lit(None).cast("string")
    older = F.array_join(F.transform(link_array(F.col("html"), Scope("nav")) if links is None else links,
                                     lambda a: item(a["story"], a["storylink"], none)), "")
    return rss_body(page_title(), F.concat(item(page_title(), F.col("url"), F.col("html")), older))


def feeds_from_pages(pages: DataFrame) -> DataFrame:
    """One RSS 2.0 body per page: (feed_id, http_status, body)."""
    return pages.select(F.col("page_id").alias("feed_id"), F.lit(200).alias("http_status"), page_body().alias("body"))


def read_feed_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed RSS documents -> (feed_id = file path, http_status, body)."""
    return (spark.read.format("binaryFile").load(path)
            .select(F.col("path").alias("feed_id"), F.lit(200).alias("http_status"),
                    F.col("content").cast("string").alias("body")))


# one file per feed ----------------------------------------------------------------
#: folders of the landed files, which Spark lists in parallel
FOLDERS = 64


def land_feed_files(feeds: DataFrame, path: str) -> None:
    """Write the bodies of ``feeds`` (feed_id, an integer; body), one file per feed; no body, no file.

    Rows of one feed share the file if one task has them, as lines.  Hadoop's local
    file system starts a process for every file and folder that it makes, so on a
    mounted file system the tasks write ``N/feed_id=I-TASK.xml`` themselves and
    move the files there when all of a task's are whole.  Elsewhere Spark writes them.
    """
    spark = feeds.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(at)
    uri = store.makeQualified(at).toUri()
    if uri.getScheme() != "file":
        # explode of a 0/1-element array: a filter on the body would build it a second time
        some = F.explode(F.filter(F.array("body"), lambda x: x.isNotNull())).alias("body")
        feeds.select("feed_id", some).write.mode("append").partitionBy("feed_id").text(path)
        return
    root, folders = uri.getPath(), FOLDERS

    def write(batches):
        import os
        import zlib

        from pyspark import TaskContext

        task = TaskContext.get()
        mine = f"{root}/.attempt-{task.taskAttemptId()}"  # readers pass over it
        os.makedirs(mine)
        for batch in batches:
            for feed, body in zip(batch["feed_id"].to_pylist(), batch["body"]):
                if body.is_valid:
                    folder = f"{mine}/{zlib.crc32(str(feed).encode()) % folders}"
                    os.makedirs(folder, exist_ok=True)
                    with open(f"{folder}/feed_id={feed}-{task.partitionId()}.xml", "ab") as f:
                        f.write(body.as_buffer())
                        f.write(b"\n")
        for folder in os.listdir(mine):
            os.makedirs(f"{root}/{folder}", exist_ok=True)
            for name in os.listdir(f"{mine}/{folder}"):
                os.replace(f"{mine}/{folder}/{name}", f"{root}/{folder}/{name}")
            os.rmdir(f"{mine}/{folder}")
        os.rmdir(mine)
        yield from ()

    feeds.select("feed_id", "body").mapInArrow(write, "feed_id bigint").collect()  # no rows


def landed_id() -> Column:
    """The feed of a file that ``land_feed_files`` wrote, from its path in ``feed_id``."""
    return F.nullif(F.regexp_extract("feed_id", r"/feed_id=(-?\d+)[-/][^/]*$", 1), F.lit("")).cast("bigint")


# item by item ---------------------------------------------------------------------
ITEM_END = "</item>"
ITEM_RE = r"(?s)^(.*?)(<item(?=[\s>]).*)$"
ITEM_SCHEMA = "title string, link string, description string, _bad string"


def _well_formed(text: Column) -> Column:
    """Whether a piece of text between items can stand inside an element."""
    parsed = F.from_xml(F.concat(F.lit("<x>"), text, F.lit("</x>")), "_bad string", {"columnNameOfCorruptRecord": "_bad"})
    return (F.trim(text) == "") | parsed["_bad"].isNull()


def item_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of the files below ``path`` up to each item's end, in file order by
    (block, row): the text before the item, and the parsed item or null.

    The text source splits files at the separator wherever a block ends.  An
    item whose text holds the separator itself (inside CDATA) is not well
    formed in pieces, so its file counts as one that does not parse.
    """
    raw = spark.read.option("lineSep", ITEM_END).option("recursiveFileLookup", "true").text(path)
    pieces = raw.select(F.col("_metadata.file_path").alias("feed_id"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("row"), "value")
    item = F.nullif(F.regexp_extract("value", ITEM_RE, 2), F.lit(""))
    pieces = pieces.select("feed_id", "block", "row", item.alias("text"),
                           F.when(item.isNull(), F.col("value")).otherwise(F.regexp_extract("value", ITEM_RE, 1)).alias("between"))
    options = {"ignoreSurroundingSpaces": "false", "columnNameOfCorruptRecord": "_bad"}
    parsed = F.from_xml(F.concat("text", F.lit(ITEM_END)), ITEM_SCHEMA, options)
    return pieces.select("feed_id", "block", "row", "between", F.when(F.col("text").isNotNull(), parsed).alias("item"))


def _pieces(chunks: DataFrame) -> DataFrame:
    """``chunks`` with what a file's status needs of them in two flags, ``alone`` and ``bad``."""
    item = F.struct("item.title", "item.link", "item.description")
    return chunks.select("feed_id", "block", "row", "between", _well_formed(F.col("between")).alias("alone"),
                         F.col("item._bad").isNotNull().alias("bad"), F.when(F.col("item").isNotNull(), item).alias("item"))


def _parsed(pieces: DataFrame) -> DataFrame:
    """(feed_id, parsed) of every file that left pieces, which is every file with a byte."""
    place = F.struct("block", "row")
    each = pieces.withColumn("some", F.col("item").isNotNull()).groupBy("feed_id").agg(
        F.min_by(F.struct("between", "alone"), place).alias("head"), F.max_by(F.struct("between", "alone", "some"), place).alias("tail"),
        F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"), F.count_if(~F.col("alone")).alias("odd"))
    # a last piece with an item ended at the end of the file, without a closing tag
    ends = F.concat("head.between", F.when(F.col("n") > 1, F.col("tail.between")).otherwise(F.lit("")))
    whole = F.from_xml(ends, "channel string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    inner = F.col("odd") - (~F.col("head.alone")).cast("int") - F.when(F.col("n") > 1, (~F.col("tail.alone")).cast("int")).otherwise(0)
    parsed = (F.col("bad") == 0) & (inner == 0) & ~F.col("tail.some") & whole["channel"].isNotNull() & whole["_bad"].isNull()
    return each.select("feed_id", F.coalesce(parsed, F.lit(False)).alias("parsed"))


def landed_status(spark: SparkSession, path: str, fetches: DataFrame | None = None) -> DataFrame:
    """(feed_id = file path, http_status, parsed) of every landed file.

    A file parses if its items do, its first and last piece are a document
    without them, and what lies between is well formed by itself.  ``fetches``
    (feed_id, http_status) adds feeds that left no file, or one without a byte
    (which Spark does not list).
    """
    files = _parsed(_pieces(item_chunks(spark, path))).withColumn("http_status", F.lit(200))
    if fetches is not None:
        told = fetches.select("feed_id", F.col("http_status").alias("told"), F.lit(True).alias("known"))
        files = files.join(told, "feed_id", "full").withColumn("http_status", F.when(F.col("known"), F.col("told")).otherwise(F.col("http_status")))
    return files.select("feed_id", "http_status", F.coalesce("parsed", F.lit(False)).alias("parsed"))


def landed_items(spark: SparkSession, path: str, fetches: DataFrame | None = None, name: Column | None = None) -> DataFrame:
    """(feed_id, item_no, title, link, description) of the files that were fetched
    and parse; items are numbered inside their block and shifted by the blocks
    before, so no task holds a file.  ``feed_id`` is the file's path, or what
    ``name`` makes of that column; ``fetches`` names feeds in the same way.

    Folders of many small files are listed once and each file is opened once:
    its pieces are materialised, in a few tasks per core, as a scan deals 32 files to a task.
    """
    name = F.col("feed_id") if name is None else name
    pieces = _pieces(item_chunks(spark, path)).coalesce(8 * spark.sparkContext.defaultParallelism)
    pieces = materialize(pieces)  # read by the status, the blocks and the items
    good = materialize(_parsed(pieces).withColumn("name", name)).where("parsed").select("feed_id", "name")
    if fetches is not None:
        success = F.coalesce(F.col("http_status").between(200, 299), F.lit(False))
        told = fetches.groupBy(F.col("feed_id").alias("name")).agg(F.max(success).alias("success"))
        good = good.join(told, "name", "left").where(F.coalesce("success", F.lit(True)))
    items = pieces.where(F.col("item").isNotNull())
    blocks = Window.partitionBy("feed_id").orderBy("block")
    shift = (items.groupBy("feed_id", "block").agg(F.count(F.lit(1)).alias("n")).join(good, "feed_id", "left_semi")
                  .select("feed_id", "block", (F.sum("n").over(blocks) - F.col("n")).alias("shift")))
    inside = Window.partitionBy("feed_id", "block").orderBy("row")
    return (items.withColumn("no", F.row_number().over(inside)).join(shift, ["feed_id", "block"])
                 .select(name.alias("feed_id"), (F.col("no") + F.col("shift")).alias("item_no"), "item.title", "item.link", "item.description"))
