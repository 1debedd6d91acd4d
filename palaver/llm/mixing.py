"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks.

A source's words form blocks of equal size. Highest quotients (weight over 1, 3, 5, ...)
hand the blocks of the whole mix to the sources, then each source's quota to its
shards. In a shard a seeded draw says which blocks are taken once more than the
others; no block is taken more often than ``most`` times.

Defined cases: a null text has size 0 and is never taken; a null source is a source of
its own, sorted last; repeated rows are separate documents; an empty table or a table
without words gives targets of 0; other columns are not looked at.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from palaver.session import materialize

from .common import mix64, plain, replaced, slices_for, whole


def _order(seed: int) -> Column:
    """Seeded place of a document in its shard."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(seed))


def _numbered(*keys: str) -> Column:
    """Numbers rows that are equal in id and text."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))


def n_words(text: Column) -> Column:
    words = plain(text)
    return F.when(words == "", 0).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "))) + 1).cast("long")


def _ranked(sources: DataFrame, width: int = 4096) -> DataFrame:
    """Adds ``rank`` (from 0) by code point, null last, without sorting all sources in one task."""
    spread = sources.repartitionByRange(slices_for(sources.count(), width), F.col("source").asc_nulls_last())
    spread = materialize(spread.withColumn("part", F.spark_partition_id()), "sources")
    sizes = spread.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return spread.join(sizes.select("part", before.alias("before")), "part").withColumn("rank", inside + F.col("before")).drop("part", "before")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """Adds weight and target. Water level: target = level * weight, at most ``most`` * size.

    Each round settles the sources above their limit and shares the rest anew; the
    driver sees three sums a round.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    df = materialize(_ranked(sources).withColumn("weight", weight).withColumn("limit", (most * F.col("source_size")).cast("double")), "weights")
    goal = share * float(df.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, F.lit(False)
    while goal:
        row = df.agg(F.sum(F.when(full, F.col("limit"))).alias("fixed"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        if not row["free"]:
            break
        new = (goal - (row["fixed"] or 0.0)) / row["free"]
        if new == level:
            break
        level = new
        full = F.col("limit") <= level * F.col("weight")
    return df.withColumn("target", F.when(full, F.col("limit")).otherwise(level * F.col("weight")) if goal else F.lit(0.0))


def quotas(rows: DataFrame, weight: str, seats: int, limit: str, order: str) -> DataFrame:
    """Sainte-Lague over a whole table: adds ``quota``; ``limit`` is the most a row can get.

    All quotients above a threshold win a seat. The threshold is found by evaluating 32
    candidates in one aggregation a round; quotients that tie with it are given by
    ``order``.
    """
    def won(x: float) -> Column:
        return F.least(F.floor(F.col(weight) / F.lit(x) + 0.5).cast("long"), F.col(limit))

    sums = rows.agg(F.sum(weight), F.count("*")).first()
    total, n = float(sums[0] or 0.0), sums[1]
    if total <= 0 or seats <= 0:
        return rows.withColumn("quota", F.lit(0).cast("long"))
    # Rounding moves each row by half a seat at most: enough seats are won at low, too few at high.
    low, high = total / (seats + n / 2 + 1), total / (seats - n / 2 - 1) if seats > n / 2 + 1 else 2 * total + 1
    while True:
        steps = [x for x in np.geomspace(low, high, 34)[1:-1] if low < x < high]
        if not steps:
            break
        sums = rows.agg(*[F.sum(won(float(x))).alias(f"s{i}") for i, x in enumerate(steps)]).first()
        enough = [x for i, x in enumerate(steps) if (sums[i] or 0) >= seats]
        exact = [x for i, x in enumerate(steps) if (sums[i] or 0) == seats]
        if exact:
            return rows.withColumn("quota", won(float(exact[0])))
        low = float(max(enough)) if enough else low
        high = float(min([x for x in steps if x > low] + [high]))
        if high / low < 1 + 1e-13:
            break
    base = rows.withColumn("quota", won(high))
    left = seats - int(base.agg(F.sum("quota")).first()[0] or 0)
    tied = base.where(won(low) > F.col("quota")).orderBy(order).limit(max(left, 0)).select(F.col(order).alias("_tied"))
    return base.join(tied, F.col(order) == F.col("_tied"), "left").withColumn(
        "quota", F.col("quota") + F.col("_tied").isNotNull().cast("long")).drop("_tied")


def _draw(group: pd.DataFrame, block: int, seed: int) -> pd.DataFrame:
    """Words taken from every document of one shard: its quota of blocks, drawn by a seeded order."""
    group = group.sort_values(["order", "doc_id", "copy"], kind="stable").reset_index(drop=True)
    ends = group["size"].to_numpy(np.int64).cumsum()
    starts, length = ends - group["size"].to_numpy(np.int64), int(ends[-1])
    count = -(-length // block)
    taken, ranges = np.zeros(len(group), np.int64), [[] for _ in range(len(group))]
    if count:
        times, extra = divmod(int(group["quota"].iloc[0]), count)
        key = mix64(np.arange(count, dtype=np.uint64) + np.uint64((int(group["shard_key"].iloc[0]) ^ seed) & (2**64 - 1)))
        again = np.zeros(count + 1, np.int64)
        again[np.argsort(key, kind="stable")[:extra]] = 1
        upto = np.concatenate([[0], np.cumsum(again)])

        def drawn(x: np.ndarray) -> np.ndarray:  # extra words before position x
            whole = x // block
            return upto[whole] * block + again[whole] * (x - whole * block)

        extra_words = drawn(ends) - drawn(starts)
        taken = times * (ends - starts) + extra_words
        for i in np.flatnonzero((extra_words > 0) & (extra_words < ends - starts)):
            first, last = starts[i] // block, (ends[i] - 1) // block
            edges = np.flatnonzero(np.diff(again[first: last + 1], prepend=0, append=0)) + first  # where drawn blocks begin and end
            inside = np.clip(edges * block, starts[i], ends[i]) - starts[i]
            ranges[i] = [tuple(map(int, x)) for x in inside.reshape(-1, 2)]
    return group.assign(taken=taken, ranges=ranges)[["doc_id", "order", "copy", "size", "rank", "taken", "ranges"]]


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: int = 2,
        block: int = 32, shard_rows: int = 8192, seed: int = 7) -> DataFrame:
    """doc_id, size, source, source_size, target and taken (words, repeats counted) per document.

    A document is taken whole ``taken // size`` times; ``ranges`` are the words of a
    further, partial copy. ``order`` (a hash of id and text) and ``copy`` (numbering
    repeated rows) say which row is meant.
    ``share``: size of the mix against all words; ``block``: words in a block;
    ``shard_rows``: documents in a shard, on average.
    """
    kind = docs.schema["doc_id"].dataType
    sized = docs.select(F.col("doc_id").cast("string"), "source", n_words(F.col("text")).alias("size"), _order(seed).alias("order"))
    sized = materialize(sized.withColumn("copy", _numbered("doc_id", "order")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    aims = materialize(targets(sources, weights, share, most), "targets")
    total = float(aims.agg(F.sum("target")).first()[0] or 0.0)
    aims = aims.withColumn("cap", F.ceil(most * F.col("source_size") / block).cast("long"))
    aims = materialize(quotas(aims, "target", round(total / block), "cap", "rank").withColumnRenamed("quota", "blocks"), "quotas")

    shards = F.ceil(F.col("n_docs") / shard_rows).cast("long")
    placed = sized.join(aims.select(F.col("source").alias("s"), "rank", "source_size", "target", "blocks", shards.alias("n_shards")),
                        F.col("source").eqNullSafe(F.col("s")))
    placed = materialize(placed.withColumn("shard", F.pmod("order", "n_shards")).drop("s"), "placed")
    parts = placed.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("blocks").alias("blocks"))
    parts = materialize(_shard_quotas(parts, block, most), "shards")
    drawn = placed.join(parts, ["rank", "shard"]).withColumn("shard_key", F.xxhash64("rank", "shard"))
    schema = "doc_id string, order long, copy int, size long, rank long, taken long, ranges array<struct<start:int,stop:int>>"
    picked = (drawn.select("doc_id", "size", "rank", "shard", "order", "copy", "quota", "shard_key")
              .groupBy("rank", "shard").applyInPandas(lambda g: _draw(g, block, seed), schema))
    return picked.join(aims.select("rank", "source", "source_size", "target"), "rank").select(
        F.col("doc_id").cast(kind), "source", "size", "source_size", "target", "taken", "order", "copy", "ranges")


def apply(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The mix itself: documents as often as they are taken, a last partial copy with its drawn words only."""
    rows = whole(docs, id=F.col("doc_id").cast("string"), order=_order(seed), text=F.col("text")).withColumn("copy", _numbered("id", "order"))
    plan = mix(docs, seed=seed, **options).where("taken > 0").select(
        F.col("doc_id").cast("string").alias("i"), F.col("order").alias("o"), F.col("copy").alias("c"), "size", "taken", "ranges")
    both = rows.join(plan, F.col("id").eqNullSafe(F.col("i")) & (F.col("order") == F.col("o")) & (F.col("copy") == F.col("c")))
    words = F.split(plain(F.col("text")), " ")
    part = F.array_join(F.flatten(F.transform("ranges", lambda r: F.slice(words, r["start"] + 1, r["stop"] - r["start"]))), " ")
    times = F.floor(F.col("taken") / F.col("size")).cast("int")
    texts = F.concat(F.array_repeat("text", times), F.when(F.size("ranges") > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    return replaced(both.withColumn("mixed", F.explode(texts)), docs, F.col("mixed"))


def _shard_quotas(parts: DataFrame, block: int, most: int, steps: int = 3) -> DataFrame:
    """Sainte-Lague of each source's blocks over its shards, by size.

    Rounding the exact shares leaves a few seats over or short; the highest quotients
    beyond, or the lowest within, settle them (``steps`` per shard are ranked).
    """
    exact = F.when(F.col("source_size") > 0, F.col("blocks") * F.col("shard_size") / F.col("source_size")).otherwise(0.0)
    cap = (most * F.ceil(F.col("shard_size") / block)).cast("long")
    df = parts.withColumn("cap", cap).withColumn("base", F.least(F.floor(exact + 0.5).cast("long"), F.col("cap")))
    gap = F.col("blocks") - F.sum("base").over(Window.partitionBy("rank"))
    df = df.withColumn("gap", gap)
    moves = df.select("rank", "shard", "gap", "shard_size", "base", "cap", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    up = (moves.where("gap > 0 and base + step < cap")
          .withColumn("quotient", -F.col("shard_size") / (2 * (F.col("base") + F.col("step")) + 1)))
    down = (moves.where("gap < 0 and base - step > 0")
            .withColumn("quotient", F.col("shard_size") / (2 * (F.col("base") - F.col("step")) - 1)))
    both = up.unionByName(down).withColumn("nth", F.row_number().over(Window.partitionBy("rank").orderBy("quotient", "shard")))
    change = (both.where(F.col("nth") <= F.abs("gap")).groupBy("rank", "shard")
              .agg(F.sum(F.signum("gap")).cast("long").alias("change")))
    return df.join(change, ["rank", "shard"], "left").select(
        "rank", "shard", (F.col("base") + F.coalesce("change", F.lit(0))).alias("quota"))
