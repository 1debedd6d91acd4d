"""Range joins on whole numbers without comparing all pairs.

A number belongs to one block of width 2^level per level. Any band [low, high] is the
union of at most two blocks per level, so a range join becomes an equi join on
(level, block) over O(log range) keys per row.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

LEVELS = 31


def blocks_of(value: Column, levels: int = LEVELS) -> Column:
    """Array of (level, block) that contain a non-negative number."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(levels - 1)),
        lambda level: F.struct(level.alias("level"), F.floor(value / F.pow(F.lit(2.0), level)).alias("block")))


def cover_of(low: Column, high: Column, levels: int = LEVELS) -> Column:
    """The disjoint blocks whose union is [low, high]; empty when low > high."""
    kind = "array<struct<level:int,block:bigint>>"

    def step(state: Column, level: Column) -> Column:
        lo, hi, out = state["lo"], state["hi"], state["out"]
        open_ = lo <= hi
        left = open_ & (F.pmod(lo, F.lit(2)) == 1)
        right = open_ & (F.pmod(hi, F.lit(2)) == 0)
        both = left & right & (lo == hi)

        def one(block: Column) -> Column:
            return F.array(F.struct(level.alias("level"), block.alias("block"))).cast(kind)

        none = F.array().cast(kind)
        grown = F.concat(out, F.when(left, one(lo)).otherwise(none), F.when(right & ~both, one(hi)).otherwise(none))
        next_lo = F.floor((lo + 1) / 2)
        next_hi = F.floor((hi - 1) / 2)
        return F.struct(
            F.when(open_, next_lo).otherwise(lo).cast("bigint").alias("lo"),
            F.when(open_, next_hi).otherwise(hi).cast("bigint").alias("hi"), grown.alias("out"))

    start = F.struct(low.cast("bigint").alias("lo"), high.cast("bigint").alias("hi"), F.array().cast(kind).alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, step, lambda s: s["out"])
