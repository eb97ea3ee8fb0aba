"""J1 edge rows (FIXTURES.md §3) on inline feeds."""

from tidings.operators import feeds as J1
from tidings.functions.html import Scope


def rss(*items, title="t"):
    body = "".join(items)
    return f'<?xml version="1.0"?><rss version="2.0"><channel><title>{title}</title>{body}</channel></rss>'


def item(title=None, link=None, desc=None):
    parts = []
    if title is not None:
        parts.append(f"<title>{title}</title>")
    if link is not None:
        parts.append(f"<link>{link}</link>")
    if desc is not None:
        parts.append(f"<description>{desc}</description>")
    return "<item>" + "".join(parts) + "</item>"


NAV = '&lt;nav&gt;&lt;a href="/x"&gt;X&lt;/a&gt;&lt;/nav&gt;'


def feeds(spark, rows):
    return spark.createDataFrame(rows, "feed_id string, http_status int, body string")


def test_cut_short_feed_is_a_parse_error(spark):
    df = feeds(spark, [("f", 200, '<rss><channel><item><title>a</title>')])
    assert J1.feed_items(df).count() == 0
    st = J1.feed_status(df).collect()[0]
    assert st.status == "parse_error" and st.error_class == "external"


def test_single_item_cdata_description_kept_as_is(spark):
    html = '<div class="x"><nav><a href="/a">A</a></nav></div>'
    df = feeds(spark, [("f", 200, rss(item("T", "http://l", f"<![CDATA[{html}]]>")))])
    rows = J1.feed_items(df).collect()
    assert len(rows) == 1 and rows[0].description == html and rows[0].item_no == 1


def test_first_item_by_position_and_missing_title(spark):
    df = feeds(spark, [
        ("a", 200, rss(item("older", "l1", NAV), item("newer", "l2", NAV))),
        ("b", 200, rss(item(None, "l1", NAV), item("second", "l2", NAV))),
        ("c", 200, rss()),
    ])
    latest = {r.feed_id: r for r in J1.latest_item(df).collect()}
    assert latest["a"].title == "older" and "c" not in latest
    titles = {r.feed_id: r for r in J1.latest_title(df).collect()}
    assert titles["a"].success and titles["a"].http_code == 200
    assert not titles["b"].success and titles["b"].http_code == 404
    assert titles["b"].error_text == "No title found"
    assert titles["c"].http_code == 404


def test_extract_links_rules(spark):
    html = ('<a href="/out">outside</a><nav><a>no href</a><a href="/x">a <b>bold</b> one </a>'
            '<a href="/x">again</a><A HREF=\'/y\' class="k">Up &amp; down</A></nav>')
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows = J1.extract_links(df).orderBy("rank").collect()
    assert [(r.rank, r.storylink, r.story) for r in rows] == [
        (1, "/x", "a bold one "), (2, "/x", "again"), (3, "/y", "Up & down")]


def links(spark, html, scope):
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    return [(r.storylink, r.story) for r in J1.extract_links(df, scope=scope).orderBy("rank").collect()]


def test_class_scope_of_any_tag(spark):
    html = ('<span class="storylink"><a href="/s">S</a></span><span><a href="/n">N</a></span>'
            '<li class="a storylink b"><span>1</span> <div><a href="/d">D</a></div></li>'
            '<span class="storylinks"><a href="/o">O</a></span><a class="storylink" href="/p">P</a>')
    assert links(spark, html, Scope(cls="storylink")) == [("/s", "S"), ("/d", "D")]
    assert links(spark, html, Scope("li", "storylink")) == [("/d", "D")]


def test_scopes_nest(spark):
    html = "<nav><nav><a href=3>3</a></nav><a href=4>4</a></nav><a href=5>5</a>"
    assert links(spark, html, Scope("nav")) == [("3", "3"), ("4", "4")]


def test_quotes_comments_scripts(spark):
    html = ("<nav><a title=\"x href='b'\" href=\"/c\">1</a><a data-x=\"a>b\" href=\"/d\">2</a>"
            "<!-- <a href=\"/no\">n</a> --><script>var t = '<a href=z>';</script><a href=1>one<a href=2>two</a></nav>")
    assert links(spark, html, Scope("nav")) == [("/c", "1"), ("/d", "2"), ("1", "one"), ("2", "two")]


def test_references_decode_once(spark):
    html = ("<nav><a href='/q?a=1&copy=2&amp;b'>&rsquo;&#146;&#38;lt;b&#38;gt;&notit;&hellip; &unknown; &#99999999999;"
            "&#x1F600;&eacute</a></nav>")
    assert links(spark, html, Scope("nav")) == [
        ("/q?a=1&copy=2&b", "\u2019\u2019&lt;b&gt;\u00acit;\u2026 &unknown; \ufffd\U0001F600\u00e9")]


def test_no_links_is_an_error_not_an_empty_list(spark):
    df = feeds(spark, [("f", 200, rss(item("T", "l", "&lt;p&gt;no links&lt;/p&gt;"))),
                       ("g", 500, rss(item("T", "l", NAV)))])
    st = {r.feed_id: r for r in J1.feed_status(df).collect()}
    assert st["f"].status == "no_links" and st["f"].n_stories == 0
    assert st["g"].status == "http_error"
    assert J1.latest_stories(df.where("feed_id = 'f'")).count() == 0


def test_link_count_equals_anchor_count(spark, sf_dir):
    from pyspark.sql import functions as F
    from tidings.sources import tables as T
    pages = T.pages(spark, sf_dir, "page_id", "html")
    anchors = pages.select(F.size(F.regexp_extract_all(
        F.regexp_extract("html", r"(?is)<nav\b[^>]*>(.*?)</nav>", 1),
        F.lit(r"<a href="), 0)).alias("n")).agg(F.sum("n")).collect()[0][0]
    assert J1.extract_links(pages).count() == anchors


def test_landed_rss_files(spark, tmp_path):
    from tidings.sources.feeds import read_feed_files
    (tmp_path / "a.xml").write_text(rss(item("first", "l1", NAV), item("second", "l2", NAV)), encoding="utf-8")
    (tmp_path / "b.xml").write_text("<rss><channel>", encoding="utf-8")
    feeds_df = read_feed_files(spark, str(tmp_path))
    st = {r.feed_id.rsplit("/", 1)[-1]: r.status for r in J1.feed_status(feeds_df).collect()}
    assert st == {"a.xml": "ok", "b.xml": "parse_error"}
    items = J1.feed_items(feeds_df).orderBy("item_no").collect()
    assert [r.title for r in items] == ["first", "second"]


def test_failed_fetch_yields_no_items(spark):
    df = feeds(spark, [("f", 503, rss(item("T", "l", NAV)))])
    assert J1.feed_items(df).count() == 0
    assert J1.latest_item(df).count() == 0
    assert J1.latest_stories(df).count() == 0
    assert J1.latest_title(df).collect()[0].http_code == 500


def test_feed_headlines_errors(spark):
    from tidings.operators import digests as J2
    df = feeds(spark, [("ok", 200, rss(item("T", "L", NAV))), ("empty", 200, rss()),
                       ("bad", 200, "<rss>"), ("down", 502, rss(item("T", "L", NAV))), ("lost", None, None),
                       ("nolink", 200, rss(item("T", None, NAV)))])
    got = {r.feed_id: (r.text, r.error_text) for r in J2.feed_headlines(df).collect()}
    assert got["ok"] == ("Latest story: T\nL", None)
    assert got["empty"] == (None, "No stories found")
    assert got["bad"] == (None, "Failed to parse RSS")
    assert got["down"] == (None, "Failed to fetch RSS feed")
    assert got["lost"] == (None, "Network error while fetching RSS feed")
    assert got["nolink"] == (None, "No link found")


def test_network_failure_is_a_class_of_its_own(spark):
    df = feeds(spark, [("f", None, None)])
    st = J1.feed_status(df).collect()[0]
    assert (st.status, st.error_class, st.error_text) == ("network_error", "network", "Network error while fetching RSS feed")
    title = J1.latest_title(df).collect()[0]
    assert (title.http_code, title.error_text) == (500, "Network error while fetching RSS feed")


def test_empty_title_is_a_title(spark):
    df = feeds(spark, [("f", 200, rss(item("", "l", NAV)))])
    assert (J1.latest_title(df).collect()[0].http_code, J1.latest_title(df).collect()[0].title) == (200, "")


def test_landed_feeds_show_every_branch(spark, sf_dir):
    from tidings.sources import fixtures as FX
    from tidings.sources import tables as T
    feeds_df = FX.landed_feeds(T.pages(spark, sf_dir))
    assert {r.status for r in J1.feed_status(feeds_df).collect()} == {
        "ok", "network_error", "http_error", "parse_error", "no_description", "no_links"}
    assert {r.http_code for r in J1.latest_title(feeds_df).collect()} == {200, 404, 500}


def test_nbsp_decodes_to_no_break_space(spark):
    df = spark.createDataFrame([(1, '<nav><a href="/a">x&nbsp;y</a></nav>')], "page_id long, html string")
    assert J1.extract_links(df).collect()[0].story == "x\u00a0y"


def test_numeric_character_references(spark):
    html = '<nav><a href="/a&#38;b">A&#66;&#x43;&#x1F600;&amp;#68;&#0;</a></nav>'
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    r = J1.extract_links(df).collect()[0]
    assert r.storylink == "/a&b" and r.story == "ABC\U0001F600&#68;\ufffd"


def test_links_after_the_last_nav_start(spark):
    """The fold rests once no nav is open or to come: not while one is open, or an anchor."""
    from tidings.functions.html import Scope, link_array
    pages = {"<nav><a href='/x'>x</a></nav><a href='/y'>y</a><p>z": [("/x", "x")],
             "<nav><a href='/x'>x</nav>y<a href='/z'>z</a>": [("/x", "x")],
             "<nav><table><tr><td></nav><a href='/z'>z</a>": [("/z", "z")],
             "<a href='/v'>v</a><nav></nav><p><b>" + "<i>t</i>" * 600 + "<nav><a href='/w'>w<b>W": [("/w", "wW")],
             "<nav><p><a href='/x'>x" + "<b>t</b>" * 300: [("/x", "x" + "t" * 300)]}
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    got = {r.id: [tuple(x) for x in r.links] for r in df.select("id", link_array(df.html, Scope("nav")).alias("links")).collect()}
    assert got == dict(enumerate(pages.values()))


def test_story_broadcast_searches_a_page_for_links_once(spark, sf_dir, monkeypatch):
    from pyspark.sql import functions as F

    from tidings.plans import registry as R
    calls, read = spark.sparkContext.accumulator(0), R.T.pages

    def same(x):
        calls.add(1)
        return x
    counted = F.udf(same, "string").asNondeterministic()
    monkeypatch.setattr(R.T, "pages", lambda *a: read(*a).withColumn("html", counted("html")))
    R.QUERIES["job_story_broadcast"](spark, sf_dir).count()
    assert calls.value == read(spark, sf_dir).count()
