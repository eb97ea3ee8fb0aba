"""Text column rules shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode White_Space, the set Rust's str::trim strips.
WHITE_SPACE = r"\p{IsWhite_Space}"
WORD_RE = r"\p{L}+"

# The cut marker and the paragraph separator of the reference.
ELLIPSIS = "..."
SECTION_BREAK = "\n\n"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def letter_words(c) -> Column:
    """Lower-cased letter runs of a text, in order."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD_RE), 0)


# Scripts written without spaces between words, and the languages
# that scripts stand for where no word is known; the reference asks for zh-tw
# for all Chinese.  U+30FC is the kana length mark.
KANA = r"\p{IsHiragana}\p{IsKatakana}\x{30FC}"
HAN = r"\p{IsHan}"
UNSPACED = KANA + HAN + r"\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
#: the scripts above start at U+0E01, so most characters are told by one comparison, without looking up their script
AS_FROM_THAI = r"\x{0E00}-\x{10FFFF}&&"
SCRIPT_LANGUAGES = {r"\p{IsHangul}": "ko", r"\p{IsThai}": "th", r"\p{IsLao}": "lo", r"\p{IsKhmer}": "km", r"\p{IsMyanmar}": "my",
                    r"\p{IsGreek}": "el", r"\p{IsHebrew}": "he", r"\p{IsArmenian}": "hy", r"\p{IsGeorgian}": "ka"}
CHINESE, JAPANESE = "zh-tw", "ja"


def has_kana(c) -> Column:
    return F.coalesce(_col(c).rlike(f"[{AS_FROM_THAI}[{KANA}]]"), F.lit(False))


def language_terms(c) -> Column:
    """Distinct terms of a text that tell its language: lower-cased words, and
    pairs of neighbouring characters in scripts without spaces (a lone
    character is a term)."""
    def pairs(run: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.char_length(run) - 1, F.lit(1)))
        return F.transform(at, lambda i: F.substring(run, i, F.lit(2)))

    def mixed(text: Column) -> Column:
        runs = F.regexp_extract_all(text, F.lit(rf"[{UNSPACED}]+|[\p{{L}}&&[^{UNSPACED}]]+"), 0)
        return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(rf"^[{UNSPACED}]"), pairs(r)).otherwise(F.array(r))))

    c = _col(c)
    return F.array_distinct(F.when(c.rlike(f"[{AS_FROM_THAI}[{UNSPACED}]]"), mixed(F.lower(c))).otherwise(letter_words(c)))


def script_language(term: Column, kana: Column) -> Column:
    """The language a term's script stands for, or null; Han characters are
    Japanese in a text with kana, else Chinese."""
    rest = F.coalesce(*[F.when(term.rlike(f"^[{script}]"), lang) for script, lang in SCRIPT_LANGUAGES.items()])
    han = F.when(kana, JAPANESE).otherwise(CHINESE)
    by_script = F.when(term.rlike(f"[{KANA}]"), JAPANESE).when(term.rlike(f"[{HAN}]"), han).otherwise(rest)
    return F.when(term >= "\u0370", by_script)  # Latin words, the most, are told by their first byte


def most_frequent(ws: Column, k: int) -> Column:
    """The ``k`` most frequent words of an array (ties by word), by sorting the
    array once and measuring its runs: n log n in the row, no shuffle."""
    def ranked(s: Column) -> Column:
        n = F.size(s)
        first = F.filter(F.sequence(F.lit(0), n - 1),
                         lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        def by_count(starts: Column) -> Column:
            run = lambda p, j: F.struct(
                (p - F.coalesce(F.get(starts, j + 1), n)).alias("less"), F.get(s, p).alias("word"))
            return F.transform(F.slice(F.sort_array(F.transform(starts, run)), 1, k), lambda x: x["word"])
        return F.when(n > 0, let(first, by_count)).otherwise(F.array().cast("array<string>"))
    return let(F.sort_array(ws), ranked)


def unicode_trim(c) -> Column:
    """Strip Unicode white space at both ends (Spark ``trim`` strips only ' ')."""
    return F.regexp_replace(_col(c), rf"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "")


def truncate_chars(c, max_chars: int) -> Column:
    """Cut to ``max_chars`` code points: first n-3 (floored at 0) then '...'."""
    c = _col(c)
    keep = max(max_chars - 3, 0)
    return (F.when(F.char_length(c) <= max_chars, c)
            .otherwise(F.concat(F.substring(c, 1, keep), F.lit(ELLIPSIS))))


def split_sections(c) -> Column:
    """Split on the exact two-newline separator, keeping empty pieces."""
    return F.split(_col(c), SECTION_BREAK, -1)


@cache
def _named() -> tuple[str, str]:
    """The standard library's table of HTML named references as a JSON object,
    and a pattern of the names that need no semicolon, longest first."""
    short = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
    return json.dumps(html5), "|".join(short)


def _decode_number(ref: Column) -> Column:
    """Character of ``&#NNN;`` or ``&#xHHH;`` as HTML reads it: numbers 128 to
    159 are windows-1252 bytes; zero, surrogates and numbers beyond Unicode
    are U+FFFD."""
    digits = F.regexp_extract(ref, r"^&#[xX]?0*([0-9a-fA-F]*)", 1)
    is_hex = ref.rlike("^&#[xX]")
    code = (F.when(F.length(digits) > 7, F.lit(-1).cast("bigint"))
             .when(is_hex, F.conv(digits, 16, 10).cast("bigint"))
             .otherwise(digits.try_cast("bigint")))
    # bytes that windows-1252 leaves open stay control characters
    bytes_ = "".join(bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160))

    def char(n: Column) -> Column:
        valid = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return (F.when(n.between(128, 159), F.substr(F.lit(bytes_), (n - 127).cast("int"), F.lit(1)))
                 .when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
                 .otherwise(F.lit("�")))
    return let(code, char)


def html_unescape(c, attribute: bool = False) -> Column:
    """Decode all named and numeric character references in one pass.

    The text is split on its references and rejoined with what each stands
    for, so decoded text is never decoded again.  In an attribute a name
    without semicolon counts only where no letter, digit or '=' follows.
    """
    c = _col(c)
    table, short = _named()
    after = "(?![A-Za-z0-9=])" if attribute else ""
    pattern = rf"&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*;|(?:{short}){after})"
    names = F.from_json(F.lit(table), "map<string,string>")

    def one(ref: Column) -> Column:
        name = F.substring(ref, 2, 64)
        prefix = F.regexp_extract(name, rf"^(?:{short})", 0)
        cut = F.concat(F.try_element_at(names, prefix), F.substr(name, F.length(prefix) + 1))
        loose = F.lit(None).cast("string") if attribute else F.when(prefix != "", cut)
        return (F.when(ref.startswith("&#"), _decode_number(ref))
                 .otherwise(F.coalesce(F.try_element_at(names, name), loose, ref)))

    chars = F.concat(F.transform(F.regexp_extract_all(c, F.lit(pattern), 0), one), F.array(F.lit("")))
    decoded = F.array_join(F.zip_with(F.split(c, pattern, -1), chars, lambda p, ch: F.concat(p, ch)), "")
    return F.when(c.contains("&"), decoded).otherwise(c)  # most texts hold no reference


def strip_tags(c) -> Column:
    """Drop every markup tag, keeping the text between them."""
    return F.regexp_replace(_col(c), r"<[^>]*>", "")


def xml_escape(c) -> Column:
    """Escape text for an XML element body."""
    c = F.regexp_replace(_col(c), "&", "&amp;")
    c = F.regexp_replace(c, "<", "&lt;")
    return F.regexp_replace(c, ">", "&gt;")
