"""Sharding by jump consistent hashing, in column functions only.

A 64-bit key seeds a linear congruential generator; each draw says at which shard
count the key would move next, and the last place reached below ``shards`` is its
shard. Nothing but the key and the count decides, no table of ring points exists, and
one more shard only takes rows into itself.

Spark's whole numbers raise on overflow, so the generator's state is kept as two
32-bit halves and multiplied in parts that always fit.

Defined results: a null key counts as key 0; equal keys share a shard; an empty table
stays empty; an existing column with the name of a result column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Multiplier of the generator as published with the algorithm.
MULTIPLIER = 2862933555777941757

HALF = 0xFFFFFFFF
#: Draws that one block makes at most; a key draws about ln(shards) times.
BLOCK = 64
#: Bits of the number of blocks in which the rows of a shard are counted.
SLOT_BITS = 12


def _times(half: Column, factor: int) -> Column:
    """``half * factor`` modulo 2^32 for two 32-bit numbers, without overflow."""
    low, high = factor & 0xFFFF, factor >> 16
    return half * F.lit(low) + F.shiftleft((half * F.lit(high)).bitwiseAND(F.lit(0xFFFF)), 16)


def next_state(hi: Column, lo: Column) -> tuple[Column, Column]:
    """``state * MULTIPLIER + 1`` modulo 2^64, as halves."""
    low, high = MULTIPLIER & HALF, MULTIPLIER >> 32
    first = lo * F.lit(low & 0xFFFF)
    second = lo * F.lit(low >> 16)
    total = first + F.shiftleft(second.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftright(total, 32) + F.shiftright(second, 16)
    upper = carry + _times(hi, low) + _times(lo, high)
    return upper.bitwiseAND(F.lit(HALF)), total.bitwiseAND(F.lit(HALF))


def halves(key: Column) -> tuple[Column, Column]:
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    return F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(HALF))


def _state(at: Column, jump: Column, hi: Column, lo: Column) -> Column:
    return F.struct(at.alias("at"), jump.alias("jump"), hi.alias("hi"), lo.alias("lo"))


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of ``key`` among ``shards``: an int from 0 to shards - 1."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")

    def draw(s: Column, _: Column) -> Column:
        hi, lo = next_state(s["hi"], s["lo"])
        far = F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + F.lit(1)).cast("double")
        moved = _state(s["jump"], ((s["jump"] + F.lit(1)).cast("double") * far).cast("long"), hi, lo)
        return F.when(s["jump"] < F.lit(shards), moved).otherwise(s)

    def block(s: Column, _: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(min(BLOCK, shards)))
        return F.when(s["jump"] < F.lit(shards), F.aggregate(steps, s, draw)).otherwise(s)

    hi, lo = halves(key)
    start = _state(F.lit(-1).cast("long"), F.lit(0).cast("long"), hi, lo)
    # Each draw moves on by one place at least, so shards draws always suffice.
    blocks = F.sequence(F.lit(1), F.lit(-(-shards // BLOCK)))
    end = block(start, F.lit(0)) if shards <= BLOCK else F.aggregate(blocks, start, block)
    return end["at"].cast("int")


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", into: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row; no rows move."""
    return docs.withColumn(into, jump_shard(F.col(key), shards))


def numbered(digests: DataFrame, shards: int) -> DataFrame:
    """Rows ``(doc_id, size, text_crc32)`` with shard, grown shard and slot.

    Slots of a shard run from 0 without a gap. Equal rows are counted first and
    written out at the end; the others are counted by blocks of a shard, cut by the bits
    of key and checksum, so neither a hot id nor a hot text meets in one task. A
    shard has at most 2^SLOT_BITS block counts.
    """
    hi, lo = next_state(*halves(F.col("doc_id")))
    checksum = F.coalesce(F.col("text_crc32"), F.lit(0).cast("long"))
    counted = (
        digests.groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("shard", jump_shard(F.col("doc_id"), shards))
        .withColumn("hi", hi)
        .withColumn("lo", lo)
        .withColumn("block", F.shiftright(F.col("hi").bitwiseXOR(checksum), 32 - SLOT_BITS))
    )
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        counted.groupBy("shard", "block")
        .agg(F.sum("copies").alias("in_block"))
        .withColumn("before", F.coalesce(F.sum("in_block").over(earlier), F.lit(0).cast("long")))
        .drop("in_block")
    )
    inside = (
        Window.partitionBy("shard", "block")
        .orderBy("hi", "lo", F.col("doc_id").asc_nulls_last(), F.col("text_crc32").asc_nulls_last(), "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    first = F.col("before") + F.coalesce(F.sum("copies").over(inside), F.lit(0).cast("long"))
    return (
        counted.join(blocks, ["shard", "block"])
        .withColumn("first", first)
        .withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - F.lit(1))))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "shard",
            (F.col("first") + F.col("nth")).alias("slot"),
            jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
        )
    )
