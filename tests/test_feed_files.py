"""Feed files read item by item equal the same bodies parsed whole."""

import os

import pytest
from pyspark.sql import functions as F

from tidings.operators import feeds as J1
from tidings.plans.registry import QUERIES
from tidings.session import shared_dir
from tidings.sources import feeds as FEEDS

HEAD, TAIL = '<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0"><channel><title>c</title>', "</channel></rss>\n"


def item(i, body=""):
    return f"<item>\n <title>t{i} &amp; é</title><link>l{i}</link>{body}</item>\n"


CDATA = "<description><![CDATA[<nav><a href='x'>one</a></nav>]]></description>"
FILES = {
    "plain.xml": HEAD + item(1, CDATA) + item(2) + TAIL,
    "one.xml": HEAD + item(1) + "<ttl>5</ttl>" + TAIL,
    "none.xml": HEAD + TAIL,
    "empty.xml": "",
    "blank.xml": "\n",
    "cut-in-item.xml": HEAD + item(1) + "<item><title>cut",
    "cut-after-title.xml": HEAD + item(1) + "<item><title>cut</title>",
    "cut-after-item.xml": HEAD + item(1) + item(2),
    "bad-item.xml": HEAD + item(1) + "<item><title>a</link></item>" + item(3) + TAIL,
    "bad-between.xml": HEAD + item(1) + "<open>" + item(2) + TAIL,
    "comment-between.xml": HEAD + item(1) + "<!-- a note --><other>x</other>" + item(2) + TAIL,
    "bad-head.xml": "<rss><channel><title>c" + item(1) + TAIL,
    "attributes.xml": HEAD + '<item id="1"><title>a</title></item><item\n><link>b</link></item>' + TAIL,
    "items-title.xml": HEAD + "<items>x</items>" + item(1) + TAIL,
    "not-xml.xml": "404 not found",
}


@pytest.fixture
def folder(tmp_path):
    for name, body in FILES.items():
        (tmp_path / name).write_text(body, encoding="utf-8")
    return str(tmp_path)


def name_of(df):
    return df.withColumn("feed_id", F.regexp_extract("feed_id", "[^/]+$", 0))


def rows(df):
    return sorted((tuple(r) for r in name_of(df).select("feed_id", "item_no", "title", "link", "description").collect()), key=str)


def test_items_equal_whole_bodies(spark, folder):
    whole = FEEDS.read_feed_files(spark, folder)
    assert rows(FEEDS.landed_items(spark, folder)) == rows(J1.feed_items(whole))
    parsed = {r["feed_id"]: r["parsed"] for r in name_of(FEEDS.landed_status(spark, folder)).collect()}
    want = {r["feed_id"]: r["ok"] for r in name_of(J1.first_items(whole).withColumn("ok", F.col("failure").isNull())).collect()}
    assert parsed == want and set(parsed) == set(FILES) - {"empty.xml"}
    assert parsed["plain.xml"] and parsed["none.xml"] and parsed["comment-between.xml"] and not parsed["cut-after-item.xml"]


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "large.xml").write_text(HEAD + "".join(item(i, CDATA if i % 3 else "") for i in range(3000)) + TAIL, encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        chunks = FEEDS.item_chunks(spark, str(tmp_path))
        assert chunks.select(F.spark_partition_id()).distinct().count() >= 8
        assert rows(FEEDS.landed_items(spark, str(tmp_path))) == rows(J1.feed_items(FEEDS.read_feed_files(spark, str(tmp_path))))
        numbers = [r["item_no"] for r in FEEDS.landed_items(spark, str(tmp_path)).orderBy("item_no").select("item_no").collect()]
        assert numbers == list(range(1, 3001))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fetches_tell_the_status(spark, folder):
    files = {r["feed_id"].rsplit("/", 1)[-1]: r["feed_id"] for r in FEEDS.landed_status(spark, folder).collect()}
    fetches = spark.createDataFrame([(files["plain.xml"], 503), (files["one.xml"], None), ("never landed", None)], "feed_id string, http_status int")
    status = {r["feed_id"].rsplit("/", 1)[-1]: (r["http_status"], r["parsed"]) for r in FEEDS.landed_status(spark, folder, fetches).collect()}
    assert status["plain.xml"] == (503, True) and status["one.xml"] == (None, True) and status["never landed"] == (None, False)
    assert status["none.xml"] == (200, True)
    with_items = {r[0] for r in rows(FEEDS.landed_items(spark, folder, fetches))}
    assert with_items == {"comment-between.xml", "attributes.xml", "items-title.xml"}


def test_separator_inside_cdata_fails_the_file(spark, tmp_path):
    (tmp_path / "odd.xml").write_text(HEAD + item(1, "<description><![CDATA[ </item> ]]></description>") + TAIL, encoding="utf-8")
    assert not FEEDS.landed_status(spark, str(tmp_path)).first()["parsed"]
    assert FEEDS.landed_items(spark, str(tmp_path)).isEmpty()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_below(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if not f.startswith(("_", ".")))


BODIES = [(1, HEAD + item(1) + TAIL), (2, None), (3, HEAD + item(2) + item(3, CDATA) + TAIL), (-4, HEAD + item(4) + TAIL),
          (5, HEAD + item(5) + TAIL), (5, HEAD + item(6) + TAIL), (None, HEAD + item(7) + TAIL)]


def landed(spark, path):
    feeds = spark.createDataFrame(BODIES, "feed_id bigint, body string").repartition(3, "feed_id")
    FEEDS.land_feed_files(feeds, path)
    found = FEEDS.landed_items(spark, path, None, FEEDS.landed_id())
    return sorted(((r["feed_id"], r["item_no"], r["link"]) for r in found.collect()), key=str)


#: two documents in one file are not one; without a body there is no file
LANDED = sorted([(1, 1, "l1"), (3, 1, "l2"), (3, 2, "l3"), (-4, 1, "l4"), (None, 1, "l7")], key=str)


def test_feeds_land_as_one_file_each(spark, tmp_path):
    path = f"{tmp_path}/a folder"
    assert landed(spark, path) == LANDED
    files = files_below(path)
    assert len(files) == 5 and len({os.path.dirname(f) for f in files}) <= FEEDS.FOLDERS
    assert not [d for d in os.listdir(path) if d.startswith(".")]  # no attempt is left
    text = {os.path.basename(f).rsplit("-", 1)[0]: open(f, encoding="utf-8").read() for f in files}
    assert text["feed_id=3"] == BODIES[2][1] + "\n"
    assert text["feed_id=5"] in (f"{a}\n{b}\n" for a, b in ((BODIES[4][1], BODIES[5][1]), (BODIES[5][1], BODIES[4][1])))


def test_a_store_that_is_not_mounted_gets_the_same_feeds(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.feeds.link./out", f"file://{tmp_path}")
    try:
        assert landed(spark, "viewfs://feeds/out/landed") == LANDED
    finally:
        conf.unset("fs.viewfs.mounttable.feeds.link./out")
    assert len(files_below(f"{tmp_path}/landed")) == 5


def test_no_feed_lands_no_file(spark, tmp_path):
    FEEDS.land_feed_files(spark.createDataFrame([], "feed_id bigint, body string"), f"{tmp_path}/none")
    assert FEEDS.landed_items(spark, f"{tmp_path}/none").isEmpty()


def test_fetches_told_twice_or_by_name(spark, folder):
    fetches = spark.createDataFrame([("plain.xml", 200), ("plain.xml", 503), ("one.xml", None), ("comment-between.xml", 200),
                                     ("comment-between.xml", 200), ("attributes.xml", 404), (None, 200), ("never landed", 200)],
                                    "feed_id string, http_status int")
    name = F.regexp_extract("feed_id", "[^/]+$", 0)
    found = sorted((r["feed_id"], r["item_no"]) for r in FEEDS.landed_items(spark, folder, fetches, name).collect())
    assert found == [("comment-between.xml", 1), ("comment-between.xml", 2), ("items-title.xml", 1), ("plain.xml", 1), ("plain.xml", 2)]


def test_each_file_is_opened_once(spark, folder):
    """The items come from pieces that are materialised, not from a scan for the blocks and one for the items."""
    assert "FileScan text" not in plan_of(FEEDS.landed_items(spark, folder))
    assert plan_of(FEEDS.landed_status(spark, folder)).count("FileScan") == 1


def test_many_feeds_land_in_few_folders_by_all_cores(spark, tmp_path):
    n = 200
    page = F.concat(F.lit("<html><title>t"), F.col("id"), F.lit("</title><nav><a href='x'>one</a></nav></html>"))
    spark.range(0, n, 1, 1).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), F.col("id")).alias("url"), page.alias("html")) \
         .write.parquet(f"{tmp_path}/pages.parquet")
    before = set(files_below(f"{shared_dir(spark)}/feed_files"))
    found = QUERIES["landed_feed_items"](spark, str(tmp_path))
    files = sorted(set(files_below(f"{shared_dir(spark)}/feed_files")) - before)
    assert len(files) == sum(i % 23 != 3 for i in range(n))
    assert len({os.path.dirname(f) for f in files}) <= FEEDS.FOLDERS < len(files)
    assert len({f.rsplit("-", 1)[1] for f in files}) == spark.sparkContext.defaultParallelism
    want = QUERIES["feed_items"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.select(*found.columns).collect()), key=str)
