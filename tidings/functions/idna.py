"""Unicode host names to ASCII, in the row.

Labels are mapped (case, full-width forms, ideographic full stops, ignored
characters) and, where they hold other than ASCII, written in Punycode by the
bootstring method with the parameters of RFC 3492.  A label is refused that
starts with a combining mark or holds a control, space, private or unassigned
character.  Known gap: letters written with combining marks are not composed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings.functions.text import let

# The parameters of Punycode, the characters that the mapping
# ignores, and those that it replaces.
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_N = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
IGNORED_RE = r"[\x{AD}\x{34F}\x{180B}-\x{180F}\x{200B}\x{2060}\x{2064}\x{FE00}-\x{FE0F}\x{FEFF}]"
REPLACED = {"。": ".", "．": ".", "｡": ".", "Σ": "σ", "İ": "i̇", **{chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F) if c != 0xFF0E}}
#: a label that cannot be one
REFUSED_RE = r"^\p{M}|[\p{Cc}\p{Cn}\p{Co}\p{Cs}\p{Z}\x{FFFD}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
#: more digits than any delta of a host needs
MOST_DIGITS = 8


def mapped(host: Column) -> Column:
    """The host with its characters mapped and lower-cased."""
    single = {k: v for k, v in REPLACED.items() if len(v) == 1}
    out = F.translate(F.regexp_replace(host, IGNORED_RE, ""), "".join(single), "".join(single.values()))
    return F.lower(F.replace(out, F.lit("İ"), F.lit(REPLACED["İ"])))


def _digit(d: Column) -> Column:
    return F.substring(F.lit(DIGITS), (d + 1).cast("int"), F.lit(1))


def _number(delta: Column, bias: Column) -> Column:
    """A delta as a variable-length number, least digit first."""
    def step(s: Column, j: Column) -> Column:
        def put(t: Column) -> Column:
            more = s["q"] >= t
            digit = F.when(more, t + (s["q"] - t) % (BASE - t)).otherwise(s["q"])
            return F.struct(F.when(more, F.floor((s["q"] - t) / (BASE - t))).otherwise(F.lit(-1)).cast("bigint").alias("q"),
                            F.concat(s["out"], _digit(digit)).alias("out"))
        t = F.greatest(F.lit(T_MIN), F.least(F.lit(T_MAX), j * BASE - bias)).cast("bigint")
        return F.when(s["q"] < 0, s).otherwise(let(t, put))
    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_DIGITS)), F.struct(delta.alias("q"), F.lit("").alias("out")), step, lambda s: s["out"])


def _adapted(delta: Column, points: Column, is_first: Column) -> Column:
    """The bias after a delta."""
    limit = (BASE - T_MIN) * T_MAX // 2
    whole = lambda x: F.floor(x).cast("bigint")

    def step(s: Column, _: Column) -> Column:
        return F.when(s["d"] > limit, F.struct(whole(s["d"] / (BASE - T_MIN)).alias("d"), (s["k"] + BASE).alias("k"))).otherwise(s)

    start = let(whole(F.when(is_first, delta / DAMP).otherwise(delta / 2)), lambda d: d + whole(d / points))
    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_DIGITS)), F.struct(start.alias("d"), F.lit(0).cast("bigint").alias("k")), step,
                       lambda s: s["k"] + whole((BASE - T_MIN + 1) * s["d"] / (s["d"] + SKEW)))


def punycode(label: Column) -> Column:
    """A label's basic characters, a hyphen if there are any, and its other characters as deltas.

    The others are inserted smallest first; a delta counts the steps from one
    insertion (character and place) to the next.
    """
    def encoded(cps: Column) -> Column:
        basic = F.array_join(F.transform(F.filter(cps, lambda c: c < FIRST_N), lambda c: F.char(c)), "")
        place = F.transform(cps, lambda c, p: F.struct(
            c.alias("c"), F.size(F.filter(F.slice(cps, 1, p), lambda x: x <= c)).cast("bigint").alias("at")))
        others = F.sort_array(F.filter(place, lambda x: x["c"] >= FIRST_N))
        n_basic = (F.size(cps) - F.size(others)).cast("bigint")

        def insert(s: Column, x: Column) -> Column:
            delta = (x["c"] - s["n"]) * (s["h"] + 1) + x["at"] - s["i"]
            return let(delta, lambda d: F.struct(
                x["c"].alias("n"), (x["at"] + 1).alias("i"), (s["h"] + 1).alias("h"),
                _adapted(d, s["h"] + 1, s["h"] == n_basic).alias("bias"), F.concat(s["out"], _number(d, s["bias"])).alias("out")))

        start = F.struct(F.lit(FIRST_N).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("i"), n_basic.alias("h"),
                         F.lit(FIRST_BIAS).cast("bigint").alias("bias"), F.lit("").alias("out"))
        return F.concat(basic, F.when(basic != "", F.lit("-")).otherwise(F.lit("")), F.aggregate(others, start, insert, lambda s: s["out"]))

    points = F.transform(F.sequence(F.lit(1), F.char_length(label)), lambda i: F.ascii(F.substring(label, i, F.lit(1))).cast("bigint"))
    return let(points, encoded)


def ascii_host(host: Column) -> Column:
    """A host name in ASCII, null when a label is refused; hosts that are ASCII are only lower-cased."""
    def label(x: Column) -> Column:
        ready = F.when(x.rlike(r"[^\x00-\x7F]"), F.concat(F.lit("xn--"), punycode(x))).otherwise(x)
        return F.when(~x.rlike(REFUSED_RE) & (x != "xn--"), ready)

    def joined(labels: Column) -> Column:
        return F.when(F.forall(labels, lambda x: x.isNotNull()), F.array_join(labels, "."))

    whole = let(F.transform(F.split(mapped(host), r"\.", -1), label), joined)
    return F.when(host.rlike(r"[^\x00-\x7F]"), whole).otherwise(F.lower(host))
