"""Unicode hosts against Python's Punycode codec."""

import random

import pytest
from pyspark.sql import functions as F

from tidings.functions import idna
from tidings.functions.url import is_valid_url, url_host


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_punycode_equals_the_codec(spark):
    rng = random.Random(7)
    alphabets = ["abcxyz019-", "äöüßéñ", "αβγδ", "日本語中文", "ことばひらがな", "한국어", "אבג", "\U0001F600\U00020000", "ไทย"]
    labels = {"ü", "bücher", "a-ü", "-ü-", "日本語", "\U0001F600", "ü" * 60, "他们为什么不说中文", "3年b組金八先生"}
    for _ in range(200):
        letters = "".join(rng.sample(alphabets, rng.randint(1, 3)))
        labels.add("".join(rng.choice(letters) for _ in range(rng.randint(1, 20))))
    df = spark.createDataFrame([(x,) for x in sorted(labels)], "t string")
    for r in df.select("t", idna.punycode(F.col("t")).alias("p")).collect():
        assert r["p"] == r["t"].encode("punycode").decode(), r["t"]


@pytest.mark.parametrize("url, host", [
    ("http://bücher.example/", "xn--bcher-kva.example"), ("http://BÜCHER.Example/x", "xn--bcher-kva.example"),
    ("http://b%C3%BCcher.example/", "xn--bcher-kva.example"), ("https://日本語。jp", "xn--wgv71a119e.jp"),
    ("http://ｅｘａｍｐｌｅ．ｃｏｍ/", "example.com"), ("http://１２７.0.0.1/", "127.0.0.1"), ("http://a­b.example/", "ab.example"),
    ("http://ΣΑΣ.gr/", f"xn--{'σασ'.encode('punycode').decode()}.gr"), ("http://faß.de/", "xn--fa-hia.de"), ("http://☃.net/", "xn--n3h.net"),
    ("http://Example.COM/", "example.com"), ("http://xn--bcher-kva.example/", "xn--bcher-kva.example"),
])
def test_hosts(spark, url, host):
    assert one(spark, url, url_host) == host


@pytest.mark.parametrize("url", [
    "http://́a.example/", "http://x.̀/", "http://a　b.example/", "http://a.example/", "http://a�b/",
    "http://%FF.example/", "http://２５６.1.1.1/", "http://‮a.example/", "http://a／b.example:x/", "http://­/",
])
def test_refused_labels(spark, url):
    assert one(spark, url, is_valid_url) is False


def test_mapped_slash_ends_no_host(spark):
    # a full-width slash maps to one only after the host has been cut out, where it is forbidden
    assert one(spark, "http://a／b.example/", is_valid_url) is False
