"""URL rules: http(s) validity and host, in the row.

Follows the WHATWG URL parser for the special schemes http/https:
leading/trailing C0 controls and spaces are stripped, tab and newline
removed, any run of '/' or '\\' after the scheme is accepted, userinfo is
skipped, hosts are percent-decoded, a host whose last label is a number must
be an IPv4 address, a bracketed host an IPv6 address, and the port at most
65535.  Known gap: IDNA host mapping.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings.functions.idna import ascii_host
from tidings.functions.text import let

URL_RE = (r"(?s)^(?i:https?):[/\\]*(?:[^/\\?#]*@)?"
          r"([^/\\?#@:\[\]\s<>^|]+|\[[0-9A-Fa-f:.]+\])"
          r"(?::0*([0-9]*))?(?:[/\\?#].*)?$")
FORBIDDEN_RE = r"[\x00-\x20#%/:<>?@\[\\\]^|\x7F]"
OCTET_RE = r"^(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_clean(c) -> Column:
    """Strip C0 controls and spaces at the ends; drop tab, CR and LF."""
    c = F.regexp_replace(_col(c), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return F.regexp_replace(c, r"[\t\r\n]", "")


def _ipv4_number(part: Column) -> Column:
    """Value of one decimal, octal or hex part; null when it is none or huge."""
    value = (F.when(part.rlike("^0[xX][0-9a-fA-F]*$"), F.conv(F.concat(F.lit("0"), F.substring(part, 3, 64)), 16, 10))
              .when(part.rlike("^0[0-7]*$"), F.conv(part, 8, 10))
              .when(part.rlike("^[1-9][0-9]*$"), part))
    return F.when(F.length(value) <= 10, value.try_cast("bigint"))


def _ipv4_ok(host: Column) -> Column:
    def ok(parts: Column) -> Column:
        n = F.size(parts)
        last = F.element_at(parts, -1)
        return ((n <= 4) & F.forall(parts, lambda p: p.isNotNull())
                & F.forall(F.slice(parts, 1, n - 1), lambda p: p <= 255)
                & (last < F.element_at(F.array(*[F.lit(256 ** k) for k in (4, 3, 2, 1)]), F.least(n, F.lit(4)))))
    return let(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), _ipv4_number), ok)


def _ipv6_ok(host: Column) -> Column:
    """Eight groups of up to four hex digits, or fewer around one '::'; the
    last two may be an IPv4 address."""
    inner = F.regexp_replace(host, r"^\[|\]$", "")
    tail = F.regexp_extract(inner, r"[^:]*\.[^:]*$", 0)
    plain = F.when((tail != "") & tail.rlike(OCTET_RE), F.regexp_replace(inner, r"[^:]*\.[^:]*$", "0:0")).otherwise(inner)

    def ok(halves: Column) -> Column:
        groups = F.flatten(F.transform(halves, lambda h: F.when(h == "", F.array().cast("array<string>")).otherwise(F.split(h, ":", -1))))
        shape = F.when(F.size(halves) == 1, F.size(groups) == 8).when(F.size(halves) == 2, F.size(groups) <= 7)
        return F.coalesce(shape, F.lit(False)) & F.forall(groups, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))
    return let(F.split(plain, "::", -1), ok)


def _decoded_host(clean: Column) -> Column:
    """Host of a cleaned URL, percent-decoded; null when it cannot be one."""
    raw = F.regexp_extract(clean, URL_RE, 1)
    plus = F.regexp_replace(raw, r"\+", "%2B")
    host = let(F.when(raw.contains("%"), F.try_url_decode(plus)).otherwise(raw), ascii_host)

    def judge(h: Column) -> Column:
        last = F.regexp_extract(h, r"([^.]*)\.?$", 1)
        good = (F.when(h.startswith("["), _ipv6_ok(h)).when(h.rlike(FORBIDDEN_RE) | (h == "") | (h == "."), False)
                 .when(last.rlike("^([0-9]+|0x[0-9a-f]*)$"), _ipv4_ok(h)).otherwise(True))
        return F.when(good, h)
    return let(host, judge)


def url_host(c) -> Column:
    """Lower-cased host of a valid http(s) URL, else null."""
    def host(u: Column) -> Column:
        port = F.regexp_extract(u, URL_RE, 2)
        port_ok = (F.length(port) <= 5) & (F.coalesce(port.try_cast("int"), F.lit(0)) <= 65535)
        return F.when(u.rlike(URL_RE) & port_ok, _decoded_host(u))
    return let(url_clean(c), host)


def is_valid_url(c) -> Column:
    """True when the text is an http or https URL with a host (never null)."""
    return url_host(c).isNotNull()
