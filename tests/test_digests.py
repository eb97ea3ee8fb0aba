"""J2 edge rows: selection by index, URL validity, translation predicate."""

from tidings.operators import digests as J2


def stories(spark, n=5, feed=1):
    rows = [(feed, [(f"/s{r}", f"Story {r}") for r in range(1, n + 1)])]
    return spark.createDataFrame(rows, "feed_id long, stories array<struct<storylink:string,story:string>>")


def sel(spark, rows):
    return spark.createDataFrame(
        rows, "request_id long, feed_id long, user_id string, language_code string, indexes array<long>")


def test_select_keeps_request_order_and_duplicates_and_renumbers(spark):
    s = sel(spark, [(1, 1, "U1", "en", [3, 1, 1, 0, -2, 99])])
    r = J2.select_stories(s, stories(spark)).collect()[0]
    assert r.n_selected == 3
    assert r.digest == "1. Story 3 /s3\n\n2. Story 1 /s1\n\n3. Story 1 /s1"


def test_rejected_selections(spark):
    s = sel(spark, [(1, 1, "U1", "en", [0, 99]), (2, 1, "U1", "en", []), (3, 1, "U1", "en", [2]),
                    (4, 77, "U1", "en", [1]), (5, 1, "U1", "en", None)])
    st = {r.request_id: r for r in J2.selection_status(s, stories(spark)).collect()}
    assert st[1].status == "rejected" and st[1].error_text == "No valid stories selected"
    assert st[2].status == "rejected" and st[3].status == "accepted"
    assert st[4].status == st[5].status == "rejected" and st[4].n_selected == 0
    assert J2.select_stories(s, stories(spark)).count() == 1


def test_digest_lines(spark):
    r = J2.story_digest(stories(spark, 2)).collect()[0]
    assert r.digest == "1. Story 1 /s1\n\n2. Story 2 /s2" and r.n_stories == 2


def test_headline_errors(spark):
    df = spark.createDataFrame([("a", None, "l"), ("b", "t", None), ("c", "t", "l")],
                               "feed_id string, title string, link string")
    r = {x.feed_id: x for x in J2.latest_headline(df).collect()}
    assert r["a"].error_text == "No title found" and r["a"].text is None
    assert r["b"].error_text == "No link found"
    assert r["c"].text == "Latest story: t\nl"


def test_valid_urls(spark):
    cases = {"https://a.example/x": True, "HTTP://A.example": True, "ftp://a.example": False,
             "a.example": False, "http://": False, "  http://a.example/": True,
             "http://a.example:99999/": False, "http://a.example:8080/p?q#f": True,
             "https://user:pw@h.example/": True, "http:a.example": True,
             "http://256.1.1.1/": False, "http://1.2.3.4.5/": False, "http://1.2.3.4/": True, "http://0x7f.1/": True,
             "http://4294967296/": False, "http://4294967295/": True, "http://1.2.3.09/": False, "http://a.1.b/": True,
             "http://[:::]/": False, "http://[::1]/": True, "http://[1:2:3:4:5:6:7:8]/": True, "http://[1:2:3]/": False,
             "http://[::1.2.3.4]/": True, "http://[1::2::3]/": False, "http://[12345::]/": False,
             "http://a.example:000080/": True, "http://a.example:/": True, "http://%41.example/": True,
             "http://%2f.example/": False, "http://a%zz.example/": False, "http://a b.example/": False, "http://a+b.example/": True}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "request_id long, url string")
    got = {r.url: r.is_valid for r in J2.valid_urls(df).collect()}
    assert got == cases
    hosts = {r.url: r.host for r in J2.valid_urls(df).collect()}
    assert hosts["HTTP://A.example"] == hosts["http://%41.example/"] == "a.example"
    assert hosts["http://a+b.example/"] == "a+b.example" and hosts["http://256.1.1.1/"] is None


def test_translate_queue_is_case_sensitive_and_untrimmed(spark):
    langs = ["en", "zh-tw", "ZH-TW", "fr", "en "]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(langs)], "request_id long, language_code string")
    got = sorted(r.language_code for r in J2.translate_queue(df).collect())
    assert got == sorted(["ZH-TW", "fr", "en "])


def test_hot_feed_is_dealt_over_tasks(spark):
    """With nine tenths of the requests on one feed no task holds far more than its part, without AQE."""
    from pyspark.sql import functions as F
    rows = [(i, 1 if i % 10 else i % 97, f"U{i}", "en", [1 + i % 3, 9]) for i in range(6000)] + [(9001, None, "U", "en", [1]), (9002, 555, "U", "en", [1])]
    selections = spark.createDataFrame(rows, "request_id long, feed_id long, user_id string, language_code string, indexes array<long>")
    stories = [(f, [(f"l{f}-{k}", f"s{k}") for k in range(3)]) for f in range(97)]
    feeds = spark.createDataFrame(stories, "feed_id long, stories array<struct<storylink:string,story:string>>")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(old, ("16", "false", "-1")):
        spark.conf.set(k, v)
    try:
        salts = {r["feed_id"]: r["salts"] for r in J2.request_salts(selections).collect()}
        assert salts[1] >= 64 and len(salts) <= 128
        picked = J2.picked_stories(selections, feeds)
        sizes = sorted(r["count"] for r in picked.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == len(rows) and len(sizes) >= 14
        assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
        got = {r["request_id"]: [s["story"] for s in r["stories"] or []] for r in picked.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {**{i: [f"s{i % 3}"] for i in range(6000)}, 9001: [], 9002: []}
