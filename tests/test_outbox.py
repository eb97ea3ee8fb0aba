"""J4 edge rows: truncation, sections, bubbles, envelopes, sink."""

import json

from pyspark.sql import functions as F

from tidings.functions.text import truncate_chars, unicode_trim
from tidings.operators import outbox as J4


def one(spark, col, value, ddl="string"):
    return spark.createDataFrame([(value,)], f"x {ddl}").select(col.alias("y")).collect()[0].y


def test_truncate_lengths_and_wide_characters(spark):
    for n, expect in ((99, "a" * 99), (100, "a" * 100), (101, "a" * 97 + "...")):
        assert one(spark, truncate_chars("x", 100), "a" * n) == expect
    assert one(spark, truncate_chars("x", 2), "abc") == "..."
    assert one(spark, truncate_chars("x", 5), "新聞摘要生成失敗") == "新聞..."
    assert one(spark, truncate_chars("x", 3), "😀😀😀") == "😀😀😀"


def test_unicode_trim(spark):
    assert one(spark, unicode_trim("x"), "　 a b\t\n ") == "a b"


def test_sections(spark):
    df = spark.createDataFrame([(1, ""), (2, "a\n\n\nb"), (3, "\n\nx\n\n"), (4, "　y　")],
                               "k long, t string")
    got = {}
    for r in J4.summary_sections(df, "t", ["k"]).collect():
        got.setdefault(r.k, []).append((r.section_no, r.section))
    assert got[1] == [(1, "")]
    assert sorted(got[2]) == [(1, "a"), (2, "b")]
    assert sorted(got[3]) == [(1, ""), (2, "x"), (3, "")]
    assert got[4] == [(1, "y")]


def bubble(spark, text):
    df = spark.createDataFrame([(1, text)], "k long, t string")
    return json.loads(J4.summary_bubbles(df, "t", ["k"], "2024-01-31")
                      .select(F.to_json("message").alias("j")).collect()[0].j)


def test_summary_bubble_separators(spark):
    b = bubble(spark, "only")
    body = b["contents"]["body"]["contents"]
    assert [c["type"] for c in body] == ["text"] and body[0]["margin"] == "none"
    b = bubble(spark, "one\n\ntwo\n\nthree")
    body = b["contents"]["body"]["contents"]
    assert [c["type"] for c in body] == ["text", "separator", "text", "separator", "text"]
    assert [c["margin"] for c in body if c["type"] == "text"] == ["none", "md", "md"]
    assert b["altText"] == "Today's Hacker News Summary"
    assert b["contents"]["header"]["contents"][1]["text"] == "2024-01-31"


def test_carousel_keys_sorted_and_one_bubble_per_story(spark):
    rows = [("f", [(r, f"/s{r}", f"Story {r}", "sum") for r in (1, 2, 3)]), ("g", [])]
    df = spark.createDataFrame(rows, "feed_id string, stories array<struct<rank:bigint,storylink:string,story:string,summary:string>>")
    assert J4.story_carousel(df).count() == 1
    c = J4.story_carousel(df).select("n_bubbles", F.to_json("message").alias("j")).collect()[0]
    msg = json.loads(c.j)
    assert c.n_bubbles == 3 and list(msg) == ["type", "altText", "contents"]
    bubbles = msg["contents"]["contents"]
    assert [b["header"]["contents"][0]["contents"][0]["text"] for b in bubbles] == ["#1", "#2", "#3"]

    def sorted_keys(o):
        if isinstance(o, dict):
            return list(o) == sorted(o) and all(sorted_keys(v) for v in o.values())
        if isinstance(o, list):
            return all(sorted_keys(v) for v in o)
        return True
    assert sorted_keys(msg["contents"])


def test_envelopes(spark):
    df = spark.createDataFrame([("U1", "rt1", "hi")], "user_id string, reply_token string, t string")
    df = df.withColumn("message", J4.text_message(F.col("t")))
    push = json.loads(J4.outbox_push(df).collect()[0].payload)
    assert push == {"to": "U1", "messages": [{"type": "text", "text": "hi"}]}
    reply = json.loads(J4.outbox_reply(df).collect()[0].payload)
    assert reply == {"replyToken": "rt1", "messages": [{"type": "text", "text": "hi"}]}
    b = J4.outbox_broadcast(df).collect()[0]
    assert b.recipient is None and json.loads(b.payload) == {"messages": [{"type": "text", "text": "hi"}]}


def test_sink_rerun_does_not_double(spark, tmp_path):
    df = spark.createDataFrame([("push", "U1", "{}")], "channel string, recipient string, payload string")
    path = str(tmp_path / "outbox")
    J4.outbox_sink(df, path, "a", "2024-01-31")
    J4.outbox_sink(df, path, "a", "2024-01-31")
    J4.outbox_sink(df, path, "a", "2024-02-01")
    out = spark.read.parquet(path)
    assert out.count() == 2 and out.where("run_date = '2024-01-31' and status = 'ready'").count() == 1


def test_jobs_of_one_channel_and_date_keep_their_rows(spark, tmp_path):
    path = str(tmp_path / "outbox")
    for job, text in (("a", "x"), ("b", "y"), ("a", "z")):
        rows = spark.createDataFrame([("broadcast", None, text, "ready")], "channel string, recipient string, payload string, status string")
        J4.outbox_sink(rows, path, job, "2024-01-31")
    assert sorted((r.job, r.payload) for r in spark.read.parquet(path).collect()) == [("a", "z"), ("b", "y")]
