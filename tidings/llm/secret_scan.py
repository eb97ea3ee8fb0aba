"""Secret scan with structural confirmation.

Base patterns report assignments, access keys and long hex runs as the
contract states them.  Structure adds spans: candidates in base64, base64url
or hex are decoded and parsed, and only those whose nested lengths close
exactly are reported.  Confirmed kinds: ``jwt`` (signed token whose header
decodes to JSON with an algorithm), ``key`` (DER private key, PEM-wrapped or
bare, in base64 or hex) and ``ssh`` (OpenSSH private key container).  Every
candidate is decoded and the decoded bytes decide, so a key is found whatever
its first characters are, also as a whole PEM block inside base64 or hex.

Edge cases: null text is empty and has no spans; whole texts of any length are
scanned; equal rows get equal spans; nothing but the text is looked at.
Offsets are code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: base patterns as given; ASCII letters in either case for the first
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE = 6
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: structural candidates
JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{11,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)")
PEM_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}?)PRIVATE KEY-----")
PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s\\:,.-]*")
BARE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
BARE_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{2}){24,}(?![0-9A-Za-z])")
KINDS = ["assign", "access", "hex", "jwt", "key", "ssh"]
MIN_KEY_BYTES = 24

RESULT = "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,spans:array<struct<kind:string,start:bigint,end:bigint>>>"


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, body) of consecutive DER items, or None unless their lengths close exactly."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > len(data):
                return None
            n, at = int.from_bytes(data[at:at + size], "big"), at + size
        if at + n > len(data):
            return None
        items.append((tag, data[at:at + n]))
        at += n
    return items


def private_der(data: bytes) -> bool:
    """A DER private key: PKCS#1, SEC 1, DSA, PKCS#8 or encrypted PKCS#8."""
    outer = der_items(data) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    inner = der_items(outer[0][1])
    if not inner:
        return False
    tags = [t for t, _ in inner]
    if tags[0] == 2 and len(inner[0][1]) == 1:
        if len(tags) in (6, 9, 10) and all(t == 2 for t in tags[:9]):
            return True  # DSA has 6 integers, RSA 9 (and an optional list of more primes)
        if tags[1:2] == [4] and len(inner[1][1]) >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:]):
            return True
    if tags[:3] == [2, 0x30, 4]:
        algorithm = der_items(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == 6 and len(inner[2][1]) >= 16
    if tags == [0x30, 4] and len(inner[1][1]) >= 32:
        algorithm = der_items(inner[0][1])
        return bool(algorithm) and algorithm[0][0] == 6 and algorithm[0][1][:8] == bytes.fromhex("2a864886f70d0105")
    return False


def openssh_key(data: bytes) -> bool:
    """The OpenSSH container: magic, then length-prefixed fields that close exactly."""
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic):
        return False
    at, sizes = len(magic), []
    for field in range(3):  # cipher, key derivation, its options
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at:at + 4], "big")
    count = int.from_bytes(data[at:at + 4], "big")
    at += 4
    for _ in range(min(count, len(data)) + 1):  # public keys, then the private block
        if at + 4 > len(data):
            return False
        sizes.append(int.from_bytes(data[at:at + 4], "big"))
        at += 4 + sizes[-1]
    return count > 0 and at == len(data) and sizes[-1] > 0


def decode64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def pem_body_kind(body: str) -> str | None:
    """What a PEM body holds; line breaks may be CR, LF or both, raw or escaped."""
    plain = re.sub(r"\\r\\n|\\n|\\r|\r\n|\r", "\n", body)
    parts = re.split(r"\n[ \t]*\n", plain)
    data = decode64(re.sub(r"\s", "", parts[-1] if ":" in plain else plain))
    encrypted = "ENCRYPTED" in plain and data  # its inside cannot be parsed
    return key_kind(data) or ("key" if encrypted else None)


def pem_blocks(text: str) -> list[tuple[int, int, str]]:
    """(start, end, body) of armored blocks: a begin mark and the next mark, if that ends the same label."""
    blocks, begin = [], None
    for m in PEM_MARK.finditer(text):
        if m[1] == "END" and begin and begin[2] == m[2] and PEM_BODY.fullmatch(text, begin.end(), m.start()):
            blocks.append((begin.start(), m.end(), text[begin.end():m.start()]))
        begin = m if m[1] == "BEGIN" else None
    return blocks


def key_kind(data: bytes | None) -> str | None:
    """Kind of a decoded candidate: DER, OpenSSH container, or a PEM block of either."""
    if not data or len(data) < MIN_KEY_BYTES:
        return None
    if data[:1] == b"\x30":
        return "key" if private_der(data) else None
    if openssh_key(data):
        return "ssh"
    if b"-----BEGIN " in data:
        for _, _, body in pem_blocks(data.decode("latin-1")):
            if kind := pem_body_kind(body):
                return kind
    return None


def jwt_header(part: str) -> bool:
    try:
        header = json.loads(decode64(part) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def structural(text: str) -> list[tuple[int, int, str]]:
    found = []
    m = JWT.search(text)
    while m:
        signed = jwt_header(m[1]) and decode64(m[2]) is not None
        if signed:
            found.append((m.start(), m.end(), "jwt"))
        m = JWT.search(text, m.end() if signed else m.end(1))  # a token may follow a dotted word
    armored = []
    if "-----BEGIN " in text:
        for a, b, body in pem_blocks(text):
            if kind := pem_body_kind(body):
                found.append((a, b, kind))
                armored.append((a, b))
    starts = [a for a, _ in armored]
    for m in BARE64.finditer(text):
        block = bisect_right(starts, m.start()) - 1
        if not (block >= 0 and m.start() < armored[block][1]) and (kind := key_kind(decode64(m[0]))):
            found.append((m.start(), m.end(), kind))
    for m in BARE_HEX.finditer(text):
        if kind := key_kind(bytes.fromhex(m[0])):
            found.append((m.start(), m.end(), kind))
    return found


def scan(text: str | None) -> tuple[int, int, int, list[dict]]:
    """Counts of the base kinds and all spans by start, then kind as listed."""
    text = text or ""
    raw = text.encode().lower()
    found = []
    if any(w in raw for w in WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    counts = [sum(k == kind for *_, k in found) for kind in KINDS[:3]]
    found += structural(text)
    found.sort(key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return (*counts, [{"kind": k, "start": a, "end": b} for a, b, k in found])


def scan_all(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scan(t) for t in text], columns=["n_assign", "n_access", "n_hex", "spans"])


def find_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus one struct column ``secrets``: base counts and all spans."""
    return small_batches(df).withColumn("secrets", F.pandas_udf(scan_all, RESULT)(F.col(text)))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: str | None, spans) -> str | None:
    """The text with every span (overlapping ones merged) replaced by a mark."""
    if text is None or spans is None or not len(spans):
        return text
    out, at, merged = [], 0, []
    for s in spans:
        if merged and s["start"] < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["end"])
        else:
            merged.append([s["start"], s["end"]])
    for a, b in merged:
        out += [text[at:a], "[SECRET]"]
        at = b
    return "".join(out) + text[at:]


def redact_all(text: pd.Series) -> pd.Series:
    return pd.Series([redact(t, scan(t)[3]) for t in text], dtype=object)


def redacted(text: Column) -> Column:
    """Texts with their secrets masked; null stays null."""
    return F.pandas_udf(redact_all, "string")(text)
