"""Best-fit packing by hierarchical residual packing.

Texts become token ids (plus a closing id); only texts longer than a sequence
are cut, from their end, so a shorter piece comes first.  Each input partition
packs its pieces by best-fit decreasing and emits its nearly full bins.  Bins
that stayed underfull are items of the next round: dealt to a quarter of the
groups, packed best-fit again, and so on up the tree.  A bin whose room is
smaller than the smallest underfull bin can never take another and is emitted
too, which also stops a flood of half-full bins from reaching the root.

Groups are sized from the count of underfull bins, and bins are dealt by a hash
of their row, so no task holds more than ``MAX_ITEMS`` items whatever their ids
are.  At every size the rounds end by one rule: when two rounds in turn, each
dealt anew over no more groups than that count needs, shrink the bins by less
than 2 %, the rest is emitted as it stands.

Edge cases: a null or empty text is the closing id alone; texts of any length
are cut into whole pieces; repeated rows are packed as often as they occur; an
empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

import re
import struct
import sys
import types
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage

CAPACITY = 2048
CLOSING_ID = 0
#: a bin with at most this much room counts as full
SLACK = 4
MAX_ITEMS = 50_000
FAN_IN = 4
#: words whose ids a worker remembers, at each of two places
CACHE_WORDS = 400_000
SPECIAL = "<|endoftext|>"
#: white space other than blanks and line breaks
OTHER_SPACE = re.compile(r"[^\S \n]")

MEMBER = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"
BIN = f"fill int, members array<{MEMBER}>"


class WordEncoder:
    """Token ids with the words met so far remembered.

    The vocabulary's word pattern always cuts before a single blank between
    two visible characters and around a single line break, so a text whose
    white space is only of these two kinds is the sequence of its lines' words
    and is looked up word by word.  Any other text is encoded as a whole.
    """

    def __init__(self, path: str | None):
        import base64

        import public_tokenizers
        import tiktoken
        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoder = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = self._pack([len(ranks)])
        self.line_break = self.whole("\n")
        self.first, self.later = {}, {}  # words at the start of a line, and after a blank
        self.path = path

    def forget(self) -> None:
        """Free the remembered words, so an idle worker holds none."""
        self.first, self.later = {}, {}

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def whole(self, text: str) -> bytes:
        return self._pack(self.encoder.encode_ordinary(text))

    def _words(self, words: list[str], known: dict[str, bytes], before: str) -> list[bytes]:
        new = {w: self.whole(before + w) for w in set(words).difference(known)}
        if len(known) < CACHE_WORDS:
            known.update(new)
        if not new:
            return [known[w] for w in words]
        return [known[w] if w in known else new[w] for w in words]

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text; a spelled special token is that token."""
        if SPECIAL in text:
            return self.special.join(map(self.encode, text.split(SPECIAL)))
        if OTHER_SPACE.search(text) or any(x in text for x in ("  ", " \n", "\n ", "\n\n")):
            return self.whole(text)
        lines = [line.split(" ") for line in text.split("\n")]
        heads = self._words([words[0] for words in lines], self.first, "")
        tails = self._words([w for words in lines for w in words[1:]], self.later, " ")
        out, at = [], 0
        for words, head in zip(lines, heads):
            out += [self.line_break, head]
            out += tails[at:at + len(words) - 1]
            at += len(words) - 1
        return b"".join(out[1:])


def word_encoder(path: str | None) -> WordEncoder:
    """One encoder per worker process; its vocabulary is loaded once."""
    state = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state"))
    if getattr(state, "encoder", None) is None or state.encoder.path != path:
        state.encoder = WordEncoder(path)
    return state.encoder


def pieces(ids: bytes) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of one document's ids, four bytes each."""
    n = len(ids) // 4
    cuts = [0, *range(n % CAPACITY or CAPACITY, n + 1, CAPACITY)]
    return [(a, b - a, zlib.crc32(ids[4 * a:4 * b])) for a, b in zip(cuts, cuts[1:])]


def best_fit(sizes: list[int]) -> list[list[int]]:
    """Best-fit decreasing; ``room[r]`` stacks the bins with room r, ``rooms`` has bit r set if any."""
    room: list[list[list[int]]] = [[] for _ in range(CAPACITY + 1)]
    rooms, bins = 0, []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            target = room[left].pop()
            if not room[left]:
                rooms ^= 1 << left
        else:
            left, target = CAPACITY, []
            bins.append(target)
        target.append(i)
        left -= size
        if left:
            room[left].append(target)
            rooms |= 1 << left
    return bins


def _merge(items: list[tuple[int, list[dict]]]) -> list[tuple[int, list[dict]]]:
    """Pack bins as items; members move by the fill of the bins before them."""
    out = []
    for chosen in best_fit([fill for fill, _ in items]):
        fill, members = 0, []
        for i in chosen:
            size, inside = items[i]
            members += [m | {"offset": m["offset"] + fill} for m in inside] if fill else inside
            fill += size
        out.append((fill, members))
    return out


def _frame(bins: list[tuple[int, list[dict]]]) -> pd.DataFrame:
    return pd.DataFrame({"fill": [f for f, _ in bins], "members": [m for _, m in bins]})


def pack_locally(batches, path: str | None = None):
    """Tokenize, cut and pack one partition, in blocks of at most MAX_ITEMS pieces."""
    items: list[tuple[int, list[dict]]] = []
    encoder, closing = word_encoder(path), CLOSING_ID.to_bytes(4, "little")
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            ids = encoder.encode(text or "") + closing
            key = None if pd.isna(doc_id) else int(doc_id)
            items += [(n, [{"doc_id": key, "piece": k, "start": a, "length": n, "ids_crc32": c, "offset": 0}])
                      for k, (a, n, c) in enumerate(pieces(ids))]
            if len(items) >= MAX_ITEMS:
                yield _frame(_merge(items))
                items = []
    encoder.forget()
    if items:
        yield _frame(_merge(items))


def pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
    order = sorted(zip(pdf["fill"], pdf["members"]), key=lambda x: (-x[0], str(x[1][0])))
    return _frame(_merge([(int(f), [dict(m) for m in ms]) for f, ms in order]))


def pack(df: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per piece with its sequence and offset."""
    source = small_batches(df).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    local = lambda batches: pack_locally(batches, vocabulary)
    bins = stage(source.mapInPandas(local, BIN))
    done, groups, before, idle = [], None, None, 0
    while True:
        n, least = (bins.filter(F.col("fill") < CAPACITY - SLACK)
                        .agg(F.count("*"), F.min("fill")).first())
        if not n:
            done.append(bins)
            break
        is_open = (F.col("fill") < CAPACITY - SLACK) & (F.col("fill") + F.lit(least) <= CAPACITY)
        done.append(bins.filter(~is_open))
        rest = bins.filter(is_open)
        n = rest.count()
        fair = -(-n // (MAX_ITEMS // 10))
        at_root = groups is not None and groups <= fair
        idle = idle + 1 if at_root and n > 0.98 * before else 0
        if n <= 1 or idle >= 2 or idle and groups == 1:  # one group is never dealt differently
            done.append(rest)
            break
        groups = fair if groups is None else max(1, fair, min(groups, n // 2) // FAN_IN)
        before = n
        deal = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(groups), F.lit(len(done))), F.lit(groups))
        bins = stage(rest.withColumn("g", deal).groupBy("g").applyInPandas(pack_group, BIN))
    packed = done[0]
    for d in done[1:]:
        packed = packed.unionByName(d)
    return (packed.withColumn("sequence_id", F.monotonically_increasing_id())
                  .select("sequence_id", F.inline("members"))
                  .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))
