"""Selected anchors by the tree of the elements."""

import time

import pytest
from pyspark.sql import functions as F

from tidings.functions.html import Scope, css, link_array

NAV = Scope("nav")
CASES = [
    # implied end tags
    ("<nav><p>a<a href=1>x</a><p><a href='2'>y<b>z</b></a></nav><a href=3>out</a>", NAV, [("1", "x"), ("2", "yz")]),
    ("<ul class='s t'><li><a href=1>one<li><a href=2>two</ul><a href=3>no</a>", Scope(cls="s"), [("1", "one"), ("2", "two")]),
    ("<p class=s>x<p><a href=1>not in it</a>", Scope(cls="s"), []),
    ("<p class=s>x<b><a href=1>in</a></b><div><a href=2>the block ended the paragraph</a></div>", Scope(cls="s"), [("1", "in")]),
    ("<li class=s>one<ul><li><a href=1>deeper</a></ul><a href=2>still one</a><li><a href=3>next</a>", Scope(cls="s"),
     [("1", "deeper"), ("2", "still one")]),
    ("<dl><dt class=s>t<a href=1>a</a><dd><a href=2>b</a></dl>", Scope(cls="s"), [("1", "a")]),
    ("<table><tr><td class=n><a href=1>c1<td><a href=2>c2<tr><td class=n><a href=3>c3</table>", Scope(cls="n"), [("1", "c1"), ("3", "c3")]),
    ("<p class=s><button><p><a href=1>a paragraph in a button leaves the outer one open</a></button><a href=2>x</a>", Scope(cls="s"),
     [("1", "a paragraph in a button leaves the outer one open"), ("2", "x")]),
    ("<nav><a href=1>x<a href=2>y</nav><a href=3>z", NAV, [("1", "x"), ("2", "y")]),
    # end tags that end nothing, or more than one element
    ("<nav><span></div><a href=1>in</a></span></nav><a href=2>o</a>", NAV, [("1", "in")]),
    ("<nav><div><section></nav><a href=1>after</a>", NAV, []),
    ("<span class=s><div></span><a href=1>an inline end tag stops at a block</a></div></span><a href=2>o</a>", Scope(cls="s"),
     [("1", "an inline end tag stops at a block")]),
    ("</nav></p><nav></li><a href=1>x</a>", NAV, [("1", "x")]),
    # the scope's own element may nest
    ("<nav><nav><a href=1>n</a></nav><a href=2>m</a></nav><a href=3>o</a>", NAV, [("1", "n"), ("2", "m")]),
    # compound selectors
    ("<div class='a b'><p><a href=1>1</a></p><span><a href=2>2</a></span></div>", Scope(path=css("div.a.b > p > a")), [("1", "1")]),
    ("<div class='b x a'><a href=1>1</a></div><div class=a><a href=2>2</a></div>", Scope(path=css(".a.b a")), [("1", "1")]),
    ("<div class=a><i><div class=b><a href=1>1</a></div></i><a href=2>2</a></div><div class=b><a href=3>3</a></div>",
     Scope(path=css(".a .b a")), [("1", "1")]),
    ("<ul><li><a href=1>1</a><b><a href=2>2</a></b></ul>", Scope(path=css("ul > li > a")), [("1", "1")]),
    ("<div><p><div><p><a href=1>1</a>", Scope(path=css("div > div > p > a")), [("1", "1")]),
    ("<div><section><div><a class='k' href=1>1</a><a href=2>2</a>", Scope(path=css("div div > a.k")), [("1", "1")]),
    # text and attributes
    ("<nav><a>no address</a><a href>e</a><img><br/><a href=q>t&amp;u<!-- c --><script>no</script></a>", NAV, [("", "e"), ("q", "t&u")]),
    ("<nav><A HREF='a>b'>x</A><a data-x='1' href=\"&amp;c\">1 < 2</a>", NAV, [("a>b", "x"), ("&c", "1 < 2")]),
    ("", NAV, []), (None, NAV, []), ("no tags", NAV, []),
]


@pytest.mark.parametrize("html, scope, want", CASES)
def test_cases(spark, html, scope, want):
    df = spark.createDataFrame([(html,)], "h string")
    assert [tuple(x) for x in df.select(link_array(F.col("h"), scope).alias("l")).first()["l"]] == want


@pytest.mark.parametrize("bad", ["", "> a", "a[href]", "a:hover", "#id a"])
def test_other_selectors_are_refused(bad):
    with pytest.raises(ValueError):
        css(bad)


def test_many_anchors_take_linear_time(spark):
    def seconds(n):
        page = "<nav>" + "".join(f"<li class=x><a href='/p/{i}'>story {i} <b>b</b></a>" for i in range(n)) + "</nav>"
        df = spark.createDataFrame([(page,)], "h string")
        counted = df.select(F.size(link_array(F.col("h"), NAV)).alias("n"))
        assert counted.first()["n"] == n
        start = time.time()
        counted.collect()
        return time.time() - start
    seconds(500)
    assert seconds(8000) < 5  # well below a second on an idle machine; quadratic folds took 13
