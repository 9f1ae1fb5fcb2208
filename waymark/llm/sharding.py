"""Shards by jump consistent hashing, in DataFrame expressions alone.

The key seeds a 64-bit linear congruential generator; each draw says at which larger number of shards the key would
move next, and the last place below the asked number is its shard. Adding a shard moves only the keys that jump there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import placed

# Fixed value: the generator's multiplier, in halves of 32 bits (the increment is 1).
MULTIPLIER = 2862933555777941757
HIGH, LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
MASK16, MASK32 = 0xFFFF, 0xFFFFFFFF


def _times_low32(x: Column, factor: int) -> tuple[Column, Column]:
    """Product of two 32-bit numbers as (low 32 bits, high 32 bits), without leaving 64-bit range."""
    a = x.bitwiseAND(F.lit(MASK16)) * F.lit(factor).cast("long")
    b = F.shiftrightunsigned(x, 16) * F.lit(factor).cast("long")
    low = a + F.shiftleft(b.bitwiseAND(F.lit(MASK16)), 16)
    return low.bitwiseAND(F.lit(MASK32)), F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(b, 16)


def _next_halves(high: Column, low: Column) -> tuple[Column, Column]:
    """state * MULTIPLIER + 1 modulo 2^64, on halves."""
    low_low, carry = _times_low32(low, LOW)
    cross = _times_low32(low, HIGH)[0] + _times_low32(high, LOW)[0]
    bumped = low_low + 1
    up = carry + cross + F.shiftrightunsigned(bumped, 32)
    return up.bitwiseAND(F.lit(MASK32)), bumped.bitwiseAND(F.lit(MASK32))


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key, 0 to ``shards`` - 1; a null key counts as 0.

    A jump always goes to a larger shard, so ``shards`` steps are enough; a step past the end leaves the state alone.
    """
    k = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(k, 32).alias("high"),
        k.bitwiseAND(F.lit(MASK32)).alias("low"),
        F.lit(-1).cast("long").alias("at"),
        F.lit(0).cast("long").alias("next"),
    )

    def step(s: Column, _: Column) -> Column:
        high, low = _next_halves(s["high"], s["low"])
        jump = F.lit(float(1 << 31)) / (F.shiftrightunsigned(high, 1) + 1).cast("double")
        moved = F.struct(
            high.alias("high"),
            low.alias("low"),
            s["next"].alias("at"),
            F.floor((s["next"] + 1).cast("double") * jump).cast("long").alias("next"),
        )
        return F.when(s["next"] < shards, moved).otherwise(s)

    steps = F.sequence(F.lit(1), F.lit(shards))
    return F.aggregate(steps, start, step, lambda s: s["at"].cast("int"))


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` (with one shard more).

    The id and the number of shards decide, so equal texts may lie apart and rows of one id lie together. The size is
    the UTF-8 length plus 1; a null text has size 1 and the checksum of an empty one. Slots of a shard run from 0
    without a gap, in an order seeded by ``seed`` (equal rows in any order); a null id goes where the key 0 goes.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    key = F.col("doc_id")
    rows = docs.select(
        "doc_id",
        size.alias("size"),
        crc.alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(key, shards).alias("shard"),
        jump_shard(key, shards + 1).alias("grown_shard"),
    )
    return placed(rows, ["shard"], ["doc_id", "size", "text_crc32"], F.lit(1).cast("long"), "slot", seed)


def assign_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The documents with their ``shard`` (in place of a column of that name); no row moves."""
    return docs.withColumn("shard", jump_shard(F.col("doc_id"), shards))
