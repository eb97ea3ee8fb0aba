"""Anchors of an HTML text, found by one pass over its tags in the row."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings.functions.text import html_unescape, let

#: comment, raw-text element, tag (quotes may hold '>'), text run, or a stray '<'
TOKEN_RE = (r"(?is)<!--.*?(?:-->|$)|<(script|style|textarea|title)\b.*?(?:</\1\s*>|$)"
            r"|</?[a-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^<]++|<")
TAG_NAME_RE = r"^</?([A-Za-z][^\s/>]*)"
#: one attribute of a tag: name and double-quoted, single-quoted or bare value
ATTRIBUTE_RE = r"[^\s\"'<>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?"
VALUE_RE = r"(?s)^[^\s=]+\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\S*))"
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
RAW = ("script", "style", "textarea", "title")

# The HTML standard's implied end tags.  A start tag in the first
# set ends the nearest open element of the second, unless one of the third is
# open inside that.
_CELLS = ("applet", "button", "caption", "marquee", "object", "table", "td", "template", "th")
_BLOCKS = ("address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption",
           "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p",
           "pre", "search", "section", "summary", "ul")
_LISTS = tuple(b for b in _BLOCKS if b not in ("address", "div", "p")) + _CELLS
IMPLIED = (
    (("li",), ("li",), _LISTS),
    (("dd", "dt"), ("dd", "dt"), _LISTS),
    ((*_BLOCKS, "li", "dd", "dt"), ("p",), _CELLS),
    (("td", "th"), ("td", "th"), ("table", "template")),
    (("tr",), ("tr",), ("table", "template")),
    (("tbody", "tfoot", "thead"), ("tbody", "tfoot", "thead"), ("table", "template")),
    (("option", "optgroup"), ("option",), ("select",)),
    (("optgroup",), ("optgroup",), ("select",)),
    (("a",), ("a",), _CELLS),
)
#: end tags of these elements reach through open inline elements, others stop at these
SPECIAL = tuple(sorted({*_BLOCKS, *_CELLS, "body", "dd", "dt", "html", "li", "select", "tbody", "tfoot", "thead", "tr"}))


@dataclass(frozen=True)
class Element:
    """What one element of a selector asks for; ``child`` asks that it lie directly in the one before."""
    tag: str | None = None
    classes: tuple[str, ...] = ()
    child: bool = False


def css(selector: str) -> tuple[Element, ...]:
    """A selector of tags and classes with descendant (blank) and child (>) steps, such as ``ul.top > li.story a``."""
    steps = re.findall(r"(>?)\s*([^\s>]+)", selector)
    parts = [(c == ">", re.fullmatch(r"(\*|[A-Za-z][\w-]*)?((?:\.[\w-]+)*)", part)) for c, part in steps]
    if not parts or any(m is None for _, m in parts) or parts[0][0]:
        raise ValueError(f"not a selector of tags and classes: {selector!r}")
    return tuple(Element(None if m[1] in (None, "*") else m[1].lower(), tuple(x for x in m[2].split(".") if x), child)
                 for child, m in parts)


@dataclass(frozen=True)
class Scope:
    """Elements whose descendants' anchors are story links.

    ``Scope(tag="nav")`` is every ``<nav>``; ``Scope(cls="storylink")`` any
    element of that class; both together narrow each other.  ``Scope(path=…)``
    takes a whole selector (``css``) that ends in the anchor itself.
    """
    tag: str | None = None
    cls: str | None = None
    path: tuple[Element, ...] | None = None

    def elements(self) -> tuple[Element, ...]:
        if self.path is not None:
            return self.path
        return (Element(self.tag and self.tag.lower(), (self.cls,) if self.cls else ()), Element("a"))


def attribute(tag: Column, name: str) -> Column:
    """Raw value of the first attribute of that name; '' without a value, null if absent."""
    found = F.filter(F.regexp_extract_all(F.regexp_replace(tag, TAG_NAME_RE, ""), F.lit(ATTRIBUTE_RE), 0),
                     lambda a: F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)) == name)
    first = F.get(found, F.lit(0))
    value = F.concat(*[F.regexp_extract(first, VALUE_RE, i) for i in (1, 2, 3)])
    return F.when(F.size(found) > 0, value)


LINK = "struct<storylink:string,story:string>"
TEXT, START, END, OTHER = 0, 1, 2, 3


def _fits(path: tuple[Element, ...], tag: Column, name: Column) -> Column:
    """Bit i is set where a start tag meets what element i of the path asks for by itself."""
    def bits(classes: Column | None) -> Column:
        total = F.lit(0)
        for i, e in enumerate(path):
            tests = [] if e.tag is None else [name == e.tag]
            tests += [F.array_contains(classes, c) for c in e.classes]
            fits = F.lit(1 << i)
            for test in tests:
                fits = F.when(test, fits).otherwise(0)
            total = total.bitwiseOR(fits)
        return total
    if not any(e.classes for e in path):
        return bits(None)
    value = F.coalesce(html_unescape(attribute(tag, "class"), True), F.lit(""))
    return let(F.split(value, r"[ \t\r\n\f]+"), bits)


def _tokens(html: Column, path: tuple[Element, ...]) -> Column:
    """array<struct<at, kind, name, fits, raw>> of the text's tokens, each looked at once."""
    def token(t: Column, at: Column) -> Column:
        def named(name: Column) -> Column:
            kind = (F.when(~t.startswith("<") | (t == "<"), TEXT).when(t.startswith("<!") | name.isin(*RAW), OTHER)
                     .when(t.startswith("</"), END).otherwise(START))
            return let(kind, lambda k: F.struct(at.alias("at"), k.alias("kind"), name.alias("name"),
                                                F.when(k == START, _fits(path, t, name)).otherwise(0).alias("fits"), t.alias("raw")))
        return let(F.when(t.startswith("<"), F.lower(F.regexp_extract(t, TAG_NAME_RE, 1))).otherwise(F.lit("")), named)
    return F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN_RE), 0), token)


def _inside(open_names: Column, name: Column) -> Column:
    """The open elements that stay when the innermost open ``name`` ends, or null; names are followed by blanks."""
    back = F.instr(F.reverse(open_names), F.reverse(F.concat(F.lit(" "), name, F.lit(" "))))
    return F.when(back > 0, F.substr(open_names, F.lit(1), F.length(open_names) - back - F.length(name)))


def _after_implied(open_names: Column, name: Column) -> Column:
    """The open elements that a start tag leaves open."""
    def ends_one(rule) -> Callable[[Column], Column]:
        _, ends, barriers = rule
        pattern = rf"^(.* )(?:{'|'.join(ends)}) (?:(?!(?:{'|'.join(barriers)}) )[^ ]+ )*$"

        def ended(x: Column) -> Column:
            opened = x.contains(f" {ends[0]} ")
            for n in ends[1:]:
                opened = opened | x.contains(f" {n} ")
            return F.when(opened, F.coalesce(F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")), x)).otherwise(x)
        return ended

    groups: dict[tuple, list[str]] = {}  # start tags that the same rules speak of
    for n in sorted({n for starts, _, _ in IMPLIED for n in starts}):
        groups.setdefault(tuple(r for r in IMPLIED if n in r[0]), []).append(n)
    left = open_names
    for rules, starts in groups.items():
        after = open_names
        for rule in rules:
            after = let(after, ends_one(rule)) if rule is not rules[0] else ends_one(rule)(after)
        left = F.when(name.isin(*starts), after).otherwise(left)
    return left


def _after_end(open_names: Column, name: Column) -> Column:
    """The open elements that an end tag leaves open: none of its name, nothing ends."""
    def checked(left: Column) -> Column:
        within = F.substr(open_names, F.length(left) + F.length(name) + 2)
        stop = F.when(name.isin(*SPECIAL), within.rlike(rf"(?:^| )(?:{'|'.join(_CELLS)}) ") & ~name.isin("table", "tr", "tbody", "tfoot", "thead"))
        return F.when(left.isNull() | F.coalesce(stop, within.rlike(rf"(?:^| )(?:{'|'.join(SPECIAL)}) ")), open_names).otherwise(left)
    innermost = open_names.endswith(F.concat(F.lit(" "), name, F.lit(" ")))
    return (F.when(innermost, F.substr(open_names, F.lit(1), F.length(open_names) - F.length(name) - 1))
             .otherwise(let(_inside(open_names, name), checked)))


#: tags of one inner fold
CHUNK = 256


def _spans(tags: Column, path: tuple[Element, ...], end: Column) -> Column:
    """array<struct<from, to>>: token places of the selected anchors and of their ends.

    One pass over the tags with the stack of open elements.  For each open
    element ``own`` has the path elements that it completes, ``all`` those that
    it or one around it does; so a child step looks at the innermost ``own``, a
    descendant step at the innermost ``all``.  A fold copies its state at each
    step, so the spans are kept as text and the tags folded chunk by chunk.
    Once no open element completes the path's first one, no tag to come meets it
    and no anchor is open, nothing can be selected and the state stays as it is.
    """
    direct = sum(1 << i for i, e in enumerate(path) if e.child)
    below = sum(1 << i for i, e in enumerate(path) if i and not e.child)
    wanted = 1 << (len(path) - 1)
    ints, none = F.array().cast("array<int>"), F.lit(-1)
    fields = ("names", "own", "all", "depth", "anchor", "since", "from", "to")
    first = F.struct(*[v.alias(k) for k, v in zip(fields, (F.lit(" "), ints, ints, F.lit(0), F.lit(0), none, none, none))])

    def state(s: Column, **new) -> Column:
        return F.struct(*[(new[k] if k in new else s[k]).alias(k) for k in fields])

    def cut(s: Column, names: Column, at: Column) -> Column:
        """``s`` with only the first elements open; the anchor that this ends, if any, goes to from and to."""
        depth = F.length(names) - F.length(F.replace(names, F.lit(" "), F.lit(""))) - 1

        def to(n: Column) -> Column:
            closes = s["anchor"] > n
            return state(s, names=names, own=F.slice(s["own"], 1, n), all=F.slice(s["all"], 1, n), depth=n,
                         anchor=F.when(closes, 0).otherwise(s["anchor"]), to=F.when(closes, at).otherwise(none),
                         **{"from": F.when(closes, s["since"]).otherwise(none)})
        return F.when(names == s["names"], state(s, to=none, **{"from": none})).otherwise(let(depth, to))

    def opened(s: Column, t: Column) -> Column:
        outer = lambda c: F.coalesce(F.get(s[c], s["depth"] - 1), F.lit(0))
        reach = F.lit(1).bitwiseOR(F.shiftleft(outer("all"), 1).bitwiseAND(below)).bitwiseOR(F.shiftleft(outer("own"), 1).bitwiseAND(direct))

        def push(own: Column) -> Column:
            chosen = (t["name"] == "a") & (own.bitwiseAND(wanted) != 0) & (s["anchor"] == 0)
            return state(s, names=F.concat(s["names"], t["name"], F.lit(" ")), own=F.concat(s["own"], F.array(own)),
                         all=F.concat(s["all"], F.array(outer("all").bitwiseOR(own))), depth=s["depth"] + 1,
                         anchor=F.when(chosen, s["depth"] + 1).otherwise(s["anchor"]),
                         since=F.when(chosen, t["at"]).otherwise(s["since"]))
        return F.when(t["name"].isin(*VOID), s).otherwise(let(t["fits"].bitwiseAND(reach), push))

    def span(start: Column, stop: Column) -> Column:
        return F.concat(start.cast("string"), F.lit(":"), stop.cast("string"), F.lit(" "))

    def step(s: Column, t: Column, last: Column) -> Column:
        inner = F.coalesce(F.get(s["now"]["all"], s["now"]["depth"] - 1), F.lit(0))
        over = (t["at"] > last) & (s["now"]["anchor"] == 0) & (inner.bitwiseAND(F.lit(1)) == 0)
        return F.when(over, s).otherwise(moved(s, t))

    def moved(s: Column, t: Column) -> Column:
        names = s["now"]["names"]
        left = F.when(t["kind"] == END, _after_end(names, t["name"])).otherwise(_after_implied(names, t["name"]))
        closed = let(left, lambda names: cut(s["now"], names, t["at"]))
        now = F.when(t["kind"] == END, closed).otherwise(let(closed, lambda c: opened(c, t)))
        done = F.when(s["now"]["from"] >= 0, F.concat(s["spans"], span(s["now"]["from"], s["now"]["to"]))).otherwise(s["spans"])
        return F.struct(now.alias("now"), done.alias("spans"))

    def chunk(s: Column, some: Column, last: Column) -> Column:
        inner = F.aggregate(some, F.struct(s["now"].alias("now"), F.lit("").alias("spans")), lambda x, t: step(x, t, last))
        return let(inner, lambda r: F.struct(r["now"].alias("now"), F.concat(s["spans"], r["spans"]).alias("spans")))

    def finish(s: Column) -> Column:
        now = s["now"]
        every = F.concat(s["spans"], F.when(now["from"] >= 0, span(now["from"], now["to"])).otherwise(F.lit("")),
                         F.when(now["anchor"] > 0, span(now["since"], end)).otherwise(F.lit("")))
        parts = F.transform(F.filter(F.split(every, " "), lambda x: x != ""), lambda x: F.split(x, ":"))
        return F.transform(parts, lambda x: F.struct(F.get(x, F.lit(0)).cast("int").alias("from"), F.get(x, F.lit(1)).cast("int").alias("to")))

    def folded(all_tags: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size(all_tags) / CHUNK).cast("int")),
                             lambda i: F.slice(all_tags, i * CHUNK + 1, F.lit(CHUNK)))
        firsts = F.transform(F.filter(all_tags, lambda t: t["fits"].bitwiseAND(F.lit(1)) != 0), lambda t: t["at"])
        return let(F.coalesce(F.array_max(firsts), none), lambda last: F.aggregate(
            chunks, F.struct(first.alias("now"), F.lit("").alias("spans")), lambda s, some: chunk(s, some, last), finish))
    return let(tags, folded)


def link_array(html: Column, scope: Scope) -> Column:
    """array<struct<storylink, story>> of the anchors under ``scope``, in order.

    Anchors without ``href`` are dropped; an anchor's text is all text inside
    it.  Elements nest by the standard's implied end tags; formatting elements
    that stay open across blocks are not opened again.
    """
    path = scope.elements()
    # elements that the path cannot see and that end nothing need no place in the stack
    plain = all(e.tag and not e.classes and not e.child for e in path)
    seen = sorted({*SPECIAL, *(n for starts, ends, _ in IMPLIED for n in (*starts, *ends)), *(e.tag for e in path if e.tag)})

    def links(tokens: Column) -> Column:
        tags = F.transform(F.filter(tokens, lambda t: t["kind"].isin(START, END) & (t["name"].isin(*seen) if plain else F.lit(True))),
                           lambda t: F.struct(t["at"], t["kind"], t["name"], t["fits"]))

        def link(span: Column) -> Column:
            within = F.slice(tokens, span["from"] + 2, span["to"] - span["from"] - 1)
            text = F.array_join(F.transform(F.filter(within, lambda t: t["kind"] == TEXT), lambda t: t["raw"]), "")
            return F.struct(html_unescape(attribute(F.get(tokens, span["from"])["raw"], "href"), True).alias("storylink"),
                            html_unescape(text).alias("story"))
        return F.filter(F.transform(_spans(tags, path, F.size(tokens)), link), lambda x: x["storylink"].isNotNull())
    return let(_tokens(html, path), links)
