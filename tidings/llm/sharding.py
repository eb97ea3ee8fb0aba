"""Sharding by jump consistent hashing, in built-in column functions only.

``jump_shard`` follows the published loop (Lamping and Veach, 2014): a
64-bit linear congruential generator seeded with the key proposes jumps until
one lands at or beyond the shard count.  Adding a shard moves rows only into
the new one, and no ring table exists.

Edge cases: a null key hashes as key 0; a null text has no bytes (size is the
fixed row overhead, crc32 of no bytes is 0); an empty table gives no rows;
rows with equal keys share a shard and get different slots; columns beyond
the key and text are carried through by ``assign_shards`` unless they have
the name of a result column, which then replaces them; texts of any length are
only measured and hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, fresh, let

#: fixed values of the published generator: multiplier 2862933555777941757
MULTIPLIER_HIGH, MULTIPLIER_LOW = 0x27BB2EE6, 0x87B0B0FD
MASK32, MASK16 = (1 << 32) - 1, (1 << 16) - 1
#: numbering groups per shard; a constant, so each group stays small at any size
SLOT_GROUPS = 1024
ROW_OVERHEAD = 16


def _times32(x: Column, y: int) -> Column:
    """x * y modulo 2**32 up to a carry, for 32-bit x and y, without overflow."""
    high = (F.shiftright(x, 16) * F.lit(y)).bitwiseAND(MASK16)
    return x.bitwiseAND(MASK16) * F.lit(y) + F.shiftleft(high, 16)


def _next_state(k: Column) -> Column:
    """k * multiplier + 1 modulo 2**64 in 16-bit steps (ANSI mode forbids wrapping)."""
    low, high = k.bitwiseAND(MASK32), F.shiftrightunsigned(k, 32)
    first = low.bitwiseAND(MASK16) * F.lit(MULTIPLIER_LOW) + F.lit(1).cast("bigint")
    second = F.shiftright(low, 16) * F.lit(MULTIPLIER_LOW)
    bottom = first.bitwiseAND(MASK32) + F.shiftleft(second.bitwiseAND(MASK16), 16)
    top = (F.shiftright(first, 32) + F.shiftright(second, 16) + F.shiftright(bottom, 32)
           + _times32(high, MULTIPLIER_LOW) + _times32(low, MULTIPLIER_HIGH))
    return F.shiftleft(top.bitwiseAND(MASK32), 32).bitwiseOR(bottom.bitwiseAND(MASK32))


def jump_shard(key: Column, shards: int) -> Column:
    """Shard (0 to shards-1) of a bigint key; at most ``shards`` jumps happen."""
    zero = F.lit(0).cast("bigint")

    def step(s: Column, _: Column) -> Column:
        def move(k: Column) -> Column:
            reach = F.lit(float(1 << 31)) / (F.shiftrightunsigned(k, 33) + 1).cast("double")
            return F.struct(k.alias("k"), s["j"].alias("b"),
                            F.floor((s["j"] + 1).cast("double") * reach).cast("bigint").alias("j"))
        return F.when(s["j"] < shards, let(_next_state(s["k"]), move)).otherwise(s)

    start = F.struct(F.coalesce(key.cast("bigint"), zero).alias("k"),
                     F.lit(-1).cast("bigint").alias("b"), zero.alias("j"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step,
                       lambda s: s["b"].cast("int"))


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with size, text_crc32, shard, grown_shard and slot.

    ``slot`` is gapless from 0 in each shard.  Rows of a shard are numbered
    inside ``SLOT_GROUPS`` hash groups and shifted by the counts of the groups
    before, so no task ever holds a shard; the shift table has at most
    ``shards * SLOT_GROUPS`` rows and is broadcast only where that many fit.
    """
    group, rank, shift, n = (fresh(df, f"_{name}") for name in ("group", "rank", "shift", "n"))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    placed = (df.withColumn("size", (F.octet_length(body) + ROW_OVERHEAD).cast("bigint"))
                .withColumn("text_crc32", F.crc32(body))
                .withColumn("shard", jump_shard(F.col(key), shards))
                .withColumn("grown_shard", jump_shard(F.col(key), shards + 1))
                .withColumn(group, F.pmod(F.xxhash64(key, "text_crc32", "size"), F.lit(SLOT_GROUPS)).cast("int")))
    before = Window.partitionBy("shard").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (placed.groupBy("shard", group).agg(F.count(F.lit(1)).alias(n))
                    .select("shard", group, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(shift)))
    if shards * SLOT_GROUPS <= BROADCAST_IDS:
        shifts = F.broadcast(shifts)
    inside = Window.partitionBy("shard", group).orderBy(key, "text_crc32", "size")
    return (placed.withColumn(rank, F.row_number().over(inside) - 1)
                  .join(shifts, ["shard", group])
                  .withColumn("slot", F.col(rank) + F.col(shift))
                  .drop(group, rank, shift))


def write_shards(df: DataFrame, path: str) -> None:
    """One folder per shard, each written by the tasks that hold its rows."""
    df.write.partitionBy("shard").mode("overwrite").parquet(path)
