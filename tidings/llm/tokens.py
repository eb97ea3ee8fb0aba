"""Hashes of the tokens of many texts at once, on their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: tokens longer than this many bytes are finished by xxhash
LONG_TOKEN = 256
#: A-Z to a-z, other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * TWO
    h = (h ^ (h >> np.uint64(29))) * ONE
    return h ^ (h >> np.uint64(32))


def token_hashes(texts: pa.Array, kinds: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, kind) of all tokens, text after text, and the number of tokens of each text.

    ``kinds`` gives each byte its kind; a token is a run of bytes of one kind
    inside a text, kind 0 separates.  Null texts have no tokens.
    """
    binary = pc.cast(pc.fill_null(texts, b""), pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], dtype=np.int64)[binary.offset:binary.offset + len(binary) + 1]
    body = binary.buffers()[2]
    data = np.zeros(offsets[-1] - offsets[0] + 8, dtype=np.uint8)  # eight bytes more, to read tokens by eights
    if body is not None:
        data[:-8] = np.frombuffer(body, dtype=np.uint8)[offsets[0]:offsets[-1]]
    if lower:
        data = LOWER[data]
    offsets = offsets - offsets[0]
    kind = kinds[data[:-8]]
    inside = kind > 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= kind[1:] != kind[:-1]
    last[:-1] &= kind[1:] != kind[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    begin, size = np.flatnonzero(first), np.flatnonzero(last)
    size = size + 1 - begin
    h = size.astype(np.uint64) * TWO
    eights = np.ndarray(max(len(data) - 7, 0), dtype="<u8", buffer=data.data, strides=(1,))
    left, at = np.arange(len(begin)), 0
    while len(left) and at < LONG_TOKEN:
        rest = np.minimum(size[left] - at, 8).astype(np.uint64)
        part = eights[begin[left] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - rest * np.uint64(8)))
        h[left] = mix(h[left] * ONE + part)
        at += 8
        left = left[size[left] > at]
    for i in left:
        h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(data[begin[i] + at:begin[i] + size[i]].tobytes()))
    return h, kind[begin], np.diff(np.searchsorted(begin, offsets))


def pieces(batches, size: int, column: str = "text"):
    """Record batches of about ``size`` bytes of text; a longer text is one of its own."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(b):
            done = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, done + size, side="right")), start + 1)
            yield b.slice(start, stop - start)
            start = stop
