"""J5 edge rows: signatures, serde-equal parsing, outcomes, tool calls, routes."""

import base64
import hashlib
import hmac
import json

from pyspark.sql import functions as F

from tidings.operators import webhooks as J5

SECRET = "s3cret"
LONG_SECRET = "k" * 100


def sign(body: bytes, secret=SECRET) -> str:
    return base64.b64encode(hmac.new(secret.encode(), body, hashlib.sha256).digest()).decode()


def hooks(spark, rows):
    return spark.createDataFrame(rows, "webhook_id long, signature string, body binary")


def ev(**kw):
    e = {"type": "message", "replyToken": "rt", "source": {"type": "user", "userId": "U1"},
         "message": {"type": "text", "text": "hi"}}
    e.update(kw)
    return e


def body(*events, extra=""):
    return (json.dumps({"events": list(events)}) + extra).encode()


def test_signatures_match_python_hmac(spark):
    b = body(ev())
    good = sign(b)
    rows = [(1, good, b), (2, good, b[:-1] + b"]"), (3, "!!notbase64", b), (4, good.rstrip("="), b),
            (5, None, b)]
    got = {r.webhook_id: r.signature_ok for r in J5.verify_signatures(hooks(spark, rows), SECRET).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}
    long_rows = [(1, sign(b, LONG_SECRET), b)]
    assert J5.verify_signatures(hooks(spark, long_rows), LONG_SECRET).collect()[0].signature_ok


def test_parse_rules(spark):
    num_text = body(ev(message={"type": "text", "text": 5}))
    no_source = body({"type": "message", "message": {"type": "text", "text": "x"}}, ev())
    unknown = body(ev(mode="active"))
    trailing = body(ev(), extra=" trailing")
    null_token = body(ev(replyToken=None))
    bad_utf8 = b'{"events":[]}\xff'
    rows = [(i, "", b) for i, b in enumerate([num_text, no_source, unknown, trailing, null_token,
                                              bad_utf8, b'{"events":null}', b"[]"])]
    got = {r.webhook_id: r.parse_ok for r in J5.parse_webhooks(hooks(spark, rows)).collect()}
    assert got == {0: False, 1: False, 2: True, 3: False, 4: True, 5: False, 6: False, 7: False}


def test_first_event_outcomes_in_order(spark):
    bodies = {
        1: body(),
        2: body(ev(type="follow")),
        3: body(ev(message=None)),
        4: body(ev(message={"type": "text", "text": ""})),
        5: body(ev(type="follow"), ev()),
        6: body(ev()),
        7: b"not json",
    }
    rows = [(k, sign(b), b) for k, b in bodies.items()] + [(8, "bad", body(ev()))]
    got = {r.webhook_id: r for r in J5.first_event_outcome(hooks(spark, rows), SECRET).collect()}
    assert {k: r.outcome for k, r in got.items()} == {
        1: "no_events", 2: "not_message", 3: "no_message", 4: "no_text", 5: "not_message",
        6: "accepted", 7: "parse_error", 8: "bad_signature"}
    assert (got[6].reply_token, got[6].user_id, got[6].text) == ("rt", "U1", "hi")


def call_body(tool_calls=None, content=None, choices=True):
    if not choices:
        return '{"choices":[]}'
    msg = {"role": "assistant", "content": content}
    if tool_calls is not None:
        msg["tool_calls"] = [{"function": {"name": n, "arguments": a}} for n, a in tool_calls]
    return json.dumps({"choices": [{"message": msg}]})


def calls(spark, rows):
    return J5.decode_tool_calls(spark.createDataFrame(rows, "key long, http_status int, body string"))


def test_decode_tool_calls(spark):
    rows = [(1, 200, call_body([("push_summary", '{"indexes":[1]}')], content="c")),
            (2, 200, call_body([], content="plain")),
            (3, 200, call_body(choices=False)),
            (4, 500, call_body(content="x")),
            (5, 200, '{"choices":[{"message":{"content":3}}]}')]
    got = {r.key: r for r in calls(spark, rows).collect()}
    assert (got[1].name, got[1].arguments, got[1].message) == ("push_summary", '{"indexes":[1]}', None)
    assert json.loads(got[1].result) == {"name": "push_summary", "arguments": '{"indexes":[1]}'}
    assert got[1].result.startswith('{"name"')
    assert (got[2].name, got[2].message, got[2].result) == (None, "plain", '{"message":"plain"}')
    assert got[3].status == "ai_error" and got[4].status == "external_error"
    assert got[5].status == "serialization_error"


def test_routes_and_arguments(spark):
    events = spark.createDataFrame([
        (1, "accepted", None, "U1", "t"), (2, "accepted", "rt", None, "t"),
        (3, "accepted", "rt", "U1", "t"), (4, "accepted", "rt", "U1", "t"),
        (5, "accepted", "rt", "U1", "t"), (6, "accepted", "rt", "U1", "t"),
        (7, "no_text", None, None, None)],
        "webhook_id long, outcome string, reply_token string, user_id string, text string")
    rows = [(1, 200, call_body([("reply_latest_story", "{}")])),
            (2, 200, call_body([("push_summary", '{"indexes":[1]}')])),
            (3, 200, call_body([("get_weather", "{}")])),
            (4, 200, call_body([("push_summary", '{"indexes":[3,1,1,-2,2.0,"4",null,true]}')])),
            (5, 200, call_body([("push_url_summary", '{"url":"http://a.example"}')])),
            (6, 200, call_body([("push_summary", 'not json')]))]
    routes = J5.route_calls(events, calls(spark, rows))
    got = {r.webhook_id: (r.route, r.outcome) for r in routes.collect()}
    assert got[1] == ("reply_latest_story", "dropped_no_reply_token")
    assert got[2] == ("push_summary", "dropped_no_user")
    assert got[3] == ("push_message", "no_message")
    assert got[4] == ("push_summary", "routed") and got[7] == (None, "no_text")
    idx = J5.call_indexes(routes).orderBy("webhook_id", "pos").collect()
    assert [(r.webhook_id, r.idx) for r in idx] == [(4, 3), (4, 1), (4, 1)]
    assert [(r.webhook_id, r.url) for r in J5.call_urls(routes).collect()] == [(5, "http://a.example")]


def test_index_array_edge_cases(spark):
    df = spark.createDataFrame([('{"indexes":"3"}',), ("not json",), ('{"indexes":[]}',), ('[1]',)], "a string")
    assert [r.i for r in df.select(J5.index_array("a").alias("i")).collect()] == [[], [], [], []]


def test_conversation_replies(spark):
    req = spark.createDataFrame([(1, b"hello"), (2, b"\xff\xfe"), (3, b"x"), (4, b"y")],
                                "request_id long, body binary")
    rows = [(1, 200, call_body([("push_summary", '{"indexes":[2]}')])),
            (2, 200, call_body(content="x")), (3, 200, call_body(content=None)),
            (4, 200, call_body(choices=False))]
    got = {r.request_id: (r.http_code, r.response)
           for r in J5.conversation_replies(req, calls(spark, rows)).collect()}
    assert got[1] == (200, '{"arguments":"{\\"indexes\\":[2]}","name":"push_summary"}')
    assert got[2] == (400, '{"error":"Invalid UTF-8 content"}')
    assert got[3] == (200, '{"message":"No message content"}')
    assert got[4] == (500, '{"error":"Failed to process conversation"}')


def test_funnel_adds_up(spark, sf_dir):
    from tidings.plans import registry as R
    routes = R._routes(spark, sf_dir)
    total = R.QUERIES["webhook_funnel"](spark, sf_dir).agg(F.sum("n")).collect()[0][0]
    assert total == routes.count() == R._webhooks(spark, sf_dir).count()


def test_repeated_keys_of_dynamic_arguments(spark):
    """Of an object's repeated keys the last one counts; text that is no JSON stays nothing."""
    cases = {
        '{"indexes":[1],"indexes":[2,3]}': [2, 3], '{"indexes":[1],"x":{"indexes":[9]},"ind\\u0065xes":[4]}': [4],
        '{"indexes":[5],"url":"a,}{\\"b","url":"c"}': [5], ' { "a" : 1 , "indexes" : [ 7 ] , "a" : [ { } ] } ': [7],
        '{"indexes":[1],"indexes":null}': [], '{"indexes":[1],"indexes":[2]} x': [], '{"indexes":[1],"indexes":[2]}}': [],
        '{"indexes":[1],"indexes":[2],}': [], '{"indexes":[1] "indexes":[2]}': [], '[{"indexes":[1],"indexes":[2]}]': [],
        '{"indexes":[1],"indexes":[2': [], '{"indexes":[1],"x":{"a":1,"a":2}}': [], "": [], '{': [], '"': [], "{}": [], '{"indexes":[8]}': [8],
    }
    df = spark.createDataFrame([(k,) for k in cases], "arguments string")
    got = {r[0]: r[1] for r in df.select("arguments", J5.index_array("arguments")).collect()}
    assert got == cases
    urls = spark.createDataFrame([("w", "push_url_summary", "routed", "U", '{"url":"http://a","url":"http://b"}')],
                                 "webhook_id string, route string, outcome string, user_id string, arguments string")
    assert [r.url for r in J5.call_urls(urls).collect()] == ["http://b"]


def test_typed_bodies_refuse_repeated_keys(spark):
    body = '{"choices":[{"message":{"content":"a","content":"b"}}]}'
    df = spark.createDataFrame([("k", 200, body)], "key string, http_status int, body string")
    assert J5.decode_tool_calls(df).first().status == "serialization_error"


def test_tool_replies_are_dealt_over_the_cores(spark):
    """AQE leaves the few bytes of the join to one task; each reply of it is then written and parsed there."""
    from tidings.sources import fixtures as FX
    turns = spark.createDataFrame([(i, t, "user", "hi") for i in range(400) for t in (0, 1)] + [(None, 1, "user", "hi")],
                                  "conv_id long, turn long, role string, text string")
    pages = spark.createDataFrame([(i, f"https://example.com/{i}") for i in range(300)], "page_id long, url string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as of large tables
    try:
        calls = J5.decode_tool_calls(FX.tool_replies(turns, pages)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(calls) == 801 and len({r.key for r in calls}) == 801
    tasks = [r.task for r in calls]
    assert len(set(tasks)) == spark.sparkContext.defaultParallelism and max(map(tasks.count, set(tasks))) < 801 / 2


def test_only_replies_to_push_summary_requests_are_parsed(spark):
    from tidings.plans import jobs
    routes = spark.createDataFrame([("a", "push_summary", "routed"), ("b", "push_summary", "dropped_no_user"), (None, "push_summary", "routed"),
                                    ("c", "push_message", "routed")], "webhook_id string, route string, outcome string")
    replies = spark.createDataFrame([("a", 500, "{}"), ("a", 200, "{broken"), ("b", 200, "{}"), ("c", 200, "{}"), (None, 200, "{}")],
                                    "webhook_id string, http_status int, body string")
    out = jobs.landed_selection_results(replies, routes)
    assert sorted(map(tuple, out.collect())) == [("a", "external_error", None), ("a", "serialization_error", None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("md5(") < plan.index("Join LeftSemi")  # the join stands below the parse
