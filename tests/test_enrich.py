"""J3 edge rows: reply parsing, defaults, language, summaries, request bodies."""

import json
import random
import re
from collections import Counter

from tidings.operators import enrich as J3

GOOD = ('{"id":"c","object":"chat.completion","created":1,"model":"m",'
        '"usage":{"prompt_tokens":1,"completion_tokens":2,"total_tokens":3},'
        '"choices":[{"message":{"role":"assistant","content":"hello"},"finish_reason":"stop","index":0}]}')


def replies(spark, rows):
    return spark.createDataFrame(rows, "key string, http_status int, body string")


def test_inference_results(spark):
    no_choice = GOOD.replace('[{"message":{"role":"assistant","content":"hello"},"finish_reason":"stop","index":0}]', "[]")
    no_usage = GOOD.replace('"usage":{"prompt_tokens":1,"completion_tokens":2,"total_tokens":3},', "")
    rows = [("ok", 200, GOOD), ("empty", 200, no_choice), ("usage", 200, no_usage),
            ("500", 500, GOOD), ("text", 200, "not json"), ("trail", 200, GOOD + " x"),
            ("big", 200, GOOD.replace('"prompt_tokens":1', '"prompt_tokens":3000000000')),
            ("float", 200, GOOD.replace('"index":0', '"index":0.0'))]
    got = {r.key: (r.status, r.content) for r in J3.inference_results(replies(spark, rows)).collect()}
    assert got["ok"] == ("ok", "hello")
    assert got["empty"][0] == "ai_error"
    assert got["usage"][0] == "serialization_error"
    assert got["500"][0] == "external_error"
    assert got["text"][0] == got["trail"][0] == got["big"][0] == got["float"][0] == "serialization_error"


def test_url_summary_results(spark):
    meta = '"meta":{"id":"m","timing":1}'
    rows = [("ok", 200, '{' + meta + ',"data":{"summary":"s"}}'),
            ("both", 200, '{' + meta + ',"data":{"summary":"s"},"error":"e"}'),
            ("neither", 200, '{' + meta + '}'),
            ("nometa", 200, '{"data":{"summary":"s"}}'),
            ("http", 503, '{' + meta + ',"data":{"summary":"s"}}')]
    df = spark.createDataFrame(rows, "key string, http_status int, body string")
    got = {r.key: (r.status, r.summary) for r in J3.url_summary_results(df).collect()}
    assert got["ok"] == ("ok", "s")
    assert got["both"][0] == got["neither"][0] == got["http"][0] == "external_error"
    assert got["nometa"][0] == "serialization_error"


def test_enrich_with_default_keeps_every_story(spark):
    st = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "feed_id long, rank long, story string")
    res = spark.createDataFrame([(1, 1, "sum")], "feed_id long, rank long, summary string")
    got = {r.rank: (r.summary, r.failed) for r in J3.enrich_with_default(st, res).collect()}
    assert got == {1: ("sum", False), 2: ("摘要生成失敗", True)}


def test_detect_language_default_and_profiles(spark):
    train = spark.createDataFrame(
        [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"),
         (3, "the bird and the fish", "en"), (4, "le poisson et le lapin", "fr"), (5, "cat chat", "de")],
        "doc_id long, text string, lang string")
    prof = J3.language_profiles(train)
    assert {r.word: r.lang for r in prof.collect()}["cat"] == "de"  # a tie goes to the smaller label
    texts = spark.createDataFrame([(10, "le chien et le chat"), (11, "xyz qqq"), (12, ""), (13, None)],
                                  "doc_id long, text string")
    got = {r.doc_id: r.language for r in J3.detect_language(texts, prof, ["doc_id"]).collect()}
    assert got == {10: "fr", 11: "en", 12: "en", 13: "en"}


def test_scripts_without_spaces(spark):
    texts = {1: ("今天天氣很好", "zh-tw"), 2: ("東京の天気予報です", "ja"), 3: ("カレーライス", "ja"), 4: ("오늘 날씨", "ko"), 5: ("สวัสดีครับ", "th"),
             6: ("新 iPhone 今天發表", "zh-tw"), 7: ("hello 世", "en"), 8: ("ｘ１２３ !!", "en"), 9: ("Привет", "en"), 10: ("ラーメン大好き", "ja")}
    train = spark.createDataFrame([("hello iphone", "en"), ("the news", "en")], "text string, lang string")
    df = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.language for r in J3.detect_language(df, J3.language_profiles(train), ["doc_id"]).collect()}
    assert got == {i: x for i, (_, x) in texts.items()}


def test_labelled_pairs_of_characters_are_learned(spark):
    train = spark.createDataFrame([("我們去公園", "zh"), ("我们去公园", "zh-CN"), ("公園に行く", "ja"), ("公園", "ja")], "text string, lang string")
    words = {r.word: r.lang for r in J3.language_profiles(train).collect()}
    assert words["我們"] == words["公园"] == "zh-tw" and words["公園"] == "ja" and words["に行"] == "ja"


def test_extract_summary_is_of_the_text_alone(spark):
    rows = [(1, "Cats purr. Dogs bark loudly. Cats and dogs play. Rain."), (2, "..."),
            (3, "Cats and dogs. Cats."), (4, None), (5, "今天下雨。明天晴天！後天呢？"), (6, "a. " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.summary for r in J3.extract_summary(docs, ["doc_id"], top_k=2, max_chars=100).collect()}
    assert got == {1: "Dogs bark loudly. Cats and dogs play.", 3: "Cats and dogs.", 5: "今天下雨。 明天晴天！", 6: "a."}
    # sentences that repeat, or add no frequent word, are not taken
    alone = J3.extract_summary(docs.where("doc_id = 1"), ["doc_id"], top_k=2, max_chars=100).collect()[0].summary
    assert alone == got[1]


def _summary_by_matrix(text, top_k, keywords=20, steps=2):
    """The rule on a written-out similarity matrix, sentence by sentence."""
    sents = [x.strip() for x in re.findall(r"[^.!?\n]+[.!?]*", text)]
    sents = [x for x in sents if re.search("[a-zA-Z]", x)]
    ws = [re.findall("[a-z]+", x.lower()) for x in sents]
    count = Counter(w for x in ws for w in x)
    keys = sorted(count, key=lambda w: (-count[w], w))[:keywords]
    weight = {w: 1 for w in keys}
    for _ in range(steps):
        worth = [sum(weight[w] for w in keys if w in x) for x in ws]
        gathered = {w: sum(worth[i] for i, x in enumerate(ws) if w in x) for w in keys}
        weight = {w: g * 1000 // max(gathered.values()) for w, g in gathered.items()}
    picks = []
    for _ in range(top_k):
        gain = [sum(weight[w] for w in keys if w in x) for x in ws]
        if not gain or max(gain) == 0:
            break
        picks.append(gain.index(max(gain)))
        weight = {w: 0 if w in ws[picks[-1]] else v for w, v in weight.items()}
    return " ".join(sents[i] for i in sorted(picks))


def test_summary_equals_the_rule_on_random_texts(spark):
    rnd, vocabulary = random.Random(7), "ant bee cat dog elk fox gnu hen ibis jay kite lark mole newt owl".split() + [
        f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(8)]
    sentence = lambda: " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 9))).capitalize()
    texts = []
    for n in range(60):
        own = [sentence() for _ in range(rnd.randint(1, 12))]
        texts.append(". ".join(rnd.choices(own, k=len(own) + n % 5)) + ".")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.summary for r in J3.extract_summary(docs, ["doc_id"], top_k=3, max_chars=10_000).collect()}
    assert got == {i: _summary_by_matrix(t, 3) for i, t in enumerate(texts)}
    for summary in got.values():
        parts = summary.split(". ")
        assert len({p.rstrip(".") for p in parts}) == len(parts)


def test_summary_needs_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "A b. C d.")], "doc_id long, text string")
    plan = J3.extract_summary(docs, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_highlights_without_letters_and_without_stories(spark):
    rows = [(1, [("/a", "red fish"), ("/b", "blue fish fish")]), (2, [("/c", "123")]), (3, [])]
    df = spark.createDataFrame(rows, "feed_id long, stories array<struct<storylink:string,story:string>>")
    got = {r.feed_id: r for r in J3.digest_highlights(df).collect()}
    assert set(got) == {1, 2}
    assert (got[1].top_rank, got[1].keywords) == (2, "fish, blue, red")
    assert got[2].highlight == "Top story: 1. 123 /c\n\n1. 123 /c"


def test_request_body_shape(spark):
    req = spark.createDataFrame([("k1", "translate", "fr: hello")], "key string, task string, content string")
    r = J3.inference_requests(req, J3.tasks_table(spark)).collect()[0]
    assert r.model == "gpt-3.5-turbo"
    assert r.body.startswith('{"model":"gpt-3.5-turbo","messages":[{"role":"user","content":"translate to  fr: hello"}]')
    assert r.body.endswith('"temperature":0.05,"max_tokens":2048,"top_p":1.0,"frequency_penalty":0.0,"presence_penalty":0.0}')
    urls = spark.createDataFrame([(1, "U", "http://a.example/x"), (2, "U", "ftp://x")],
                                 "request_id long, user_id string, url string")
    bodies = [json.loads(x.body) for x in J3.url_summary_requests(urls).collect()]
    assert bodies == [{"engine": "agnes", "target_language": "EN", "url": "http://a.example/x"}]


def test_a_text_is_searched_once_not_once_per_term(spark):
    """Kana are looked for below the explode, and votes are counted in hash tables (mode() sorts beyond 128 keys)."""
    train = spark.createDataFrame([("the cat", "en"), ("le chat", "fr")], "text string, lang string").localCheckpoint()
    texts = spark.createDataFrame([(1, "the dog", "x"), (2, "ラーメン", None), (None, None, None), (None, "le chat", None)],
                                  "doc_id long, text string, tag string").localCheckpoint()
    got = J3.detect_language(texts, J3.language_profiles(train), ["doc_id", "tag"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    kana = [i for i, x in enumerate(lines) if "IsHiragana" in x and "AS _kana" in x]
    generate = [i for i, x in enumerate(lines) if "Generate" in x and "true" in x]
    assert kana and generate and kana[0] > generate[0]
    assert "mode(" not in plan
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "x", "en"), (2, None, "ja"), (None, None, "fr")], key=str)


def test_profiles_of_many_words_are_counted_in_hash_tables(spark):
    """Labels of 600 words, with ties, null labels and repeated rows; no typed aggregate, which would sort its rows."""
    rnd = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    rows = [(n % 2, " ".join(rnd.choices(words, k=40)), rnd.choice(["en", "fr", "de", None, "zh-CN"])) for n in range(200)] * 2
    got = J3.language_profiles(spark.createDataFrame(rows, "half int, text string, lang string"), by=["half"])
    counts = Counter((h, w, "zh-tw" if x == "zh-CN" else x) for h, t, x in rows if x for w in set(t.split()))
    want = {}
    for (h, w, x), n in counts.items():
        want[h, w] = min(want.get((h, w), (0, "")), (-n, x))
    assert {(r.half, r.word): r.lang for r in got.collect()} == {k: x for k, (_, x) in want.items()} and got.count() == len(want)
    assert "ObjectHashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
