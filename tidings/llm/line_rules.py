"""Quality rules, line first: drop failing lines, then documents that lose too much.

Each line is judged by itself (end punctuation, shouting, symbols, navigation
bars, boilerplate phrases, word loops); failing lines leave the text, and a
document is rejected when more than ``MAX_LOSS`` of its word characters left.
Base counts and the base verdict come first.

Edge cases: null text counts as text without words (rejected by the base
rule); lines without a word are neither judged nor lost; any length of text is
processed whole; columns other than the text are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: fixed values of the base contract
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\r\x0b\x0c"
#: parameters of the line rules
MAX_LOSS = 0.5
LONG_LINE = 12
SEPARATORS = {"|", ">", "<", "»", "«", "·", "•", "/", "-", "–", "—", "::", ">>"}
END_MARKS = ".!?:;…。！？\"')]}”’»"
BOILERPLATE = re.compile(
    r"all rights reserved|licen[sc]ed under|released under the|terms of (use|service)"
    r"|privacy policy|cookie (policy|settings)|we use cookies|accept (all )?cookies"
    r"|sign up for|subscribe to our|enable javascript|lorem ipsum|^copyright\b|©", re.I)

RESULT = ("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,"
          "n_repeat_words:bigint,base_failed:boolean,lines_removed:bigint,lost:double,"
          "kept:boolean,clean_text:string>")


def repeated_words(tokens: list) -> int:
    """Words inside 3-word windows that the text holds at least twice."""
    windows = list(zip(tokens, tokens[1:], tokens[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered, until = 0, 0  # ``until``: first position not yet counted
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + 3 - max(i, until)
            until = i + 3
    return covered


def line_fails(line: str) -> str | None:
    """Name of the first rule that a line with words fails, or None."""
    tokens = line.split()
    n = len(tokens)
    if BOILERPLATE.search(line):
        return "boilerplate"
    if n >= 3 and 5 * sum(t in SEPARATORS for t in tokens) >= n:
        return "navigation"
    chars = sum(map(len, tokens))
    if n >= 3 and 10 * sum(line.count(c) for c in "#*$%&|<>") > chars:
        return "symbols"
    if n >= 4 and (2 * line.count("!") > n or 10 * sum(map(str.isupper, line)) > 7 * chars):
        return "shouting"
    if n >= 10 and 4 * len(set(tokens)) < n:
        return "word loop"
    if line.rstrip()[-1] not in END_MARKS:
        if n < LONG_LINE or not re.search(r"[.!?,;:]", line):
            return "no end punctuation"
    return None


def judge(text: str | None) -> tuple:
    raw = (text or "").encode()
    tokens = raw.split()
    solid = len(text or "") - (len(raw) - len(raw.translate(None, WHITE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = repeated_words(tokens)
    failed = len(tokens) < MIN_WORDS or 100 * repeats > 50 * len(tokens)
    kept_lines, lost, removed = [], 0, 0
    for line in (text or "").split("\n"):
        if line.strip() and line_fails(line):
            lost += sum(map(len, line.split()))
            removed += 1
        else:
            kept_lines.append(line)
    share = lost / solid if solid else 0.0
    return (len(tokens), solid, symbols, len(lines) - len(set(lines)), repeats, failed, removed,
            share, not failed and share <= MAX_LOSS, "\n".join(kept_lines))


def judge_all(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([judge(t) for t in text], columns=re.findall(r"(\w+):", RESULT))


def line_first(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus one struct column ``rules`` with the counts, verdicts and clean text."""
    return small_batches(df).withColumn("rules", F.pandas_udf(judge_all, RESULT)(F.col(text)))
