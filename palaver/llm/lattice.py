"""Near-duplicate vectors by hashing to cells of the E8 lattice, with verified cosine.

Unit vectors are projected to blocks of eight random directions, shifted, and decoded to the
nearest point of E8 (whole or half coordinates with an even sum). The points of all blocks of a table make
a cell. A vector lies in its home cell and also probes, block by block, the neighbouring
lattice point that is next nearest; pairs meet where a home cell is a home or a probe of the other. With
12 tables of two blocks at scale 0.5 a pair at cosine 0.95 is missed with probability
0.001, one at 0.97 with 2e-5 (measured on 60,000 pairs each; larger scales or more blocks give smaller cells for larger tables).

Exact copies are one class. Where ``dense`` classes or more share a cell, those within half the
allowed angle of their mean form a ball: all its members link with one another, so none of
these pairs is listed. Only pairs of balls (a class outside any ball is a ball of one) are
listed; the triangle inequality settles most pairs of large balls at once, the members of the rest are compared
in tiles of bounded size. Pairs of single vectors first pass a 64-bit sign sketch: at the allowed angle
more than ``bits`` differing bits have a probability of 1e-9.

Defined cases: null, zero and empty vectors and those with null or non-finite components have no link and are their own
component; vectors of different length never link; repeated rows and equal vectors count as links of each other; a
null id is a component's smallest only if all are null; ties do not arise; other columns are not looked at; an empty table
gives an empty result. Long vectors cost in proportion to their length.
"""
from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from palaver.functions.vectors import dot, norm, weighted_centroids
from palaver.session import materialize

from .common import mix64
from .graph import components

GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Rows decoded at once.
SLICE = 512
#: Safety of angle bounds against rounding.
MARGIN = 1e-6


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [[a if k == i else b if k == j else 0.0 for k in range(8)]
             for i, j in itertools.combinations(range(8), 2) for a in (1.0, -1.0) for b in (1.0, -1.0)]
    half = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + [list(s) for s in half])


SHORTEST = minimal_vectors()


def _even(y: np.ndarray) -> np.ndarray:
    """Nearest whole point with an even sum: round, and where the sum is odd turn the worst coordinate."""
    point = np.rint(y)
    odd = np.flatnonzero(point.sum(1).astype(np.int64) & 1)
    rest = y[odd] - point[odd]
    worst = np.abs(rest).argmax(1)
    point[odd, worst] += np.where(rest[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return point


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest point of E8 of each row."""
    whole, half = _even(y), _even(y - 0.5) + 0.5
    nearer = ((y - whole) ** 2).sum(1) <= ((y - half) ** 2).sum(1)
    return np.where(nearer[:, None], whole, half)


def next_nearest(y: np.ndarray, point: np.ndarray) -> np.ndarray:
    """The lattice neighbour of ``point`` that lies nearest to y."""
    return point + SHORTEST[((y - point) @ SHORTEST.T).argmax(1)]


def _fold(numbers: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One 64-bit number for the last axis, chained from ``start``."""
    h = start
    for i in range(numbers.shape[-1]):
        h = mix64(h * GOLD + numbers[..., i])
    return h


class Cells:
    """Random projections for vectors of one length."""

    def __init__(self, width: int, tables: int, blocks: int, scale: float, seed: int):
        rng = np.random.default_rng([seed, width])
        self.tables, self.blocks = tables, blocks
        self.directions = rng.standard_normal((width, tables * blocks * 8)) * scale
        self.shift = rng.random(tables * blocks * 8) * 2
        self.signs = rng.standard_normal((width, 64))
        self.name = mix64(np.arange(tables, dtype=np.uint64) + np.uint64(width << 16))

    def of(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home cells (n, tables), probed cells (n, tables x blocks) and sign sketches (n)."""
        y = (unit @ self.directions + self.shift).reshape(-1, 8)
        home = decode(y)
        near = next_nearest(y, home)

        def block_hash(points: np.ndarray) -> np.ndarray:
            doubled = np.rint(points * 2).astype(np.int64).view(np.uint64)
            return _fold(doubled, np.zeros(len(points), np.uint64)).reshape(-1, self.tables, self.blocks)

        own, other = block_hash(home), block_hash(near)
        start = np.broadcast_to(self.name, own.shape[:2])
        probes = []
        for b in range(self.blocks):
            swapped = own.copy()
            swapped[:, :, b] = other[:, :, b]
            probes.append(_fold(swapped, start))
        bits = np.packbits(unit @ self.signs > 0, axis=1).view(np.int64).reshape(-1)
        return _fold(own, start).view(np.int64), np.concatenate(probes, axis=1).view(np.int64), bits


def _clean(batch: pd.Series) -> list[np.ndarray | None]:
    """Vectors in double precision, None where a vector takes no part."""
    out = []
    for x in batch:
        x = None if x is None else np.asarray(x, dtype=float) + 0.0
        out.append(x if x is not None and x.size and np.isfinite(x).all() and x.any() else None)
    return out


def _key(x: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(x.tobytes())


def _sign(batches: Iterator[pd.DataFrame], tables: int, blocks: int, scale: float, seed: int) -> Iterator[pd.DataFrame]:
    hashes: dict[int, Cells] = {}
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            part = batch.iloc[at: at + SLICE]
            rows = _clean(part["embedding"])
            out = pd.DataFrame({"vec_id": part["vec_id"].to_numpy(object), "key": [None if x is None else _key(x) for x in rows],
                                "sketch": pd.array([0] * len(rows), "Int64"), "cells": None, "probes": None})
            for width in {len(x) for x in rows if x is not None}:
                spots = [i for i, x in enumerate(rows) if x is not None and len(x) == width]
                x = np.stack([rows[i] for i in spots])
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                if width not in hashes:
                    hashes[width] = Cells(width, tables, blocks, scale, seed)
                home, probes, bits = hashes[width].of(x)
                for n, i in enumerate(spots):
                    out.at[i, "sketch"], out.at[i, "cells"], out.at[i, "probes"] = int(bits[n]), home[n], probes[n]
            yield out


def _vectors(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, x (doubles) of the wanted classes, read again from the table."""
    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(_key(x), x) for x in _clean(batch["embedding"]) if x is not None]
            yield pd.DataFrame({"key": pd.Series([k for k, _ in found], dtype=object), "x": pd.Series([x for _, x in found], dtype=object)})

    every = rows.select("embedding").mapInPandas(keyed, "key binary, x array<double>")
    return every.join(wanted.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("x").alias("x"))


def _compare(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """Members of two balls, one tile each: how many vectors of the other side each one links with."""
    sides = [frame[frame["side"] == s] for s in (0, 1)]
    if not (len(sides[0]) and len(sides[1])):
        return frame.iloc[:0][["key", "a", "b"]].assign(more=0)
    units = []
    for s in sides:
        x = np.stack(s["x"].to_numpy())
        units.append((x, np.linalg.norm(x, axis=1)))
    cosine = (units[0][0] @ units[1][0].T) / np.outer(units[0][1], units[1][1])
    linked = cosine >= least
    more = [linked @ sides[1]["copies"].to_numpy(), sides[0]["copies"].to_numpy() @ linked]
    out = pd.concat([s[["key", "a", "b"]].assign(more=m) for s, m in zip(sides, more)])
    return out[out["more"] > 0]


def groups(rows: DataFrame, least: float = 0.95, tables: int = 12, blocks: int = 2, scale: float = 0.5, dense: int = 16,
           bits: int = 24, tile: int = 1024, seed: int = 13) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``rows`` (vec_id, embedding).

    ``least``: smallest cosine of a link; ``tables``, ``blocks``, ``scale``: see the module;
    ``dense``: classes in a cell from which balls are formed; ``tile``: members of a ball in one task.
    """
    kind = rows.schema["vec_id"].dataType
    allowed = math.acos(least)
    source = rows.select(F.col("vec_id").cast("string"), "embedding")
    signed = source.mapInPandas(lambda it: _sign(it, tables, blocks, scale, seed),
                                "vec_id string, key binary, sketch long, cells array<long>, probes array<long>")
    signed = materialize(signed.withColumn("vec_id", F.col("vec_id").cast(kind)), "signed")
    classes = materialize(signed.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"),
        F.first("cells").alias("cells"), F.first("probes").alias("probes")), "classes")

    # Balls: each class joins the fullest of its cells, if it lies near enough to the mean of those who do.
    homes = classes.select("key", F.explode("cells").alias("cell"))
    full = homes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= dense)
    choice = homes.join(full, "cell").groupBy("key").agg(F.max(F.struct("n", "cell")).alias("top")).select("key", F.col("top.cell").alias("cell"))
    crowd = materialize(choice.join(_vectors(rows, choice), "key"), "crowd")
    unit = crowd.select("key", "cell", F.transform("x", lambda v: v / norm(F.col("x"))).alias("u"))
    centres = weighted_centroids(unit.withColumn("one", F.lit(1)), ["cell"], "u", "one").select("cell", F.col("centroid").alias("centre"))
    centres = materialize(centres, "centres")
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(F.col("u"), F.col("centre")))))
    inside = unit.join(centres, "cell").select("key", "cell", angle.alias("angle")).where(F.col("angle") <= allowed / 2 - MARGIN)
    name = F.concat(F.lit("c"), F.hex("cell")).cast("binary")
    member = materialize(classes.select("key", "least", "copies", "sketch", "cells", "probes").join(inside, "key", "left").select(
        "key", "least", "copies", "sketch", "cells", "probes", F.coalesce(name, F.col("key")).alias("ball"), F.col("cell").isNotNull().alias("many"),
        F.coalesce("angle", F.lit(0.0)).alias("angle")), "members")
    balls = materialize(member.groupBy("ball", "many").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies"), F.max("angle").alias("radius")), "balls")

    # Pairs of balls that meet in a cell, each ball once a cell.
    def placed(cells) -> DataFrame:
        return member.select("ball", F.when(~F.col("many"), F.col("sketch")).alias("sketch"), F.explode(cells).alias("cell")).groupBy(
            "cell", "ball").agg(F.max("sketch").alias("sketch"))

    here = placed(F.col("cells"))
    there = placed(F.concat("cells", "probes")).select("cell", F.col("ball").alias("other"), F.col("sketch").alias("theirs"))
    close = F.coalesce(F.bit_count(F.col("sketch").bitwiseXOR(F.col("theirs"))) <= bits, F.lit(True))
    met = here.join(there, (here["cell"] == there["cell"]) & (F.col("ball") != F.col("other")) & close)
    pairs = materialize(met.select(F.least("ball", "other").alias("a"), F.greatest("ball", "other").alias("b")).distinct(), "pairs")

    # Settle pairs of balls by their centres.
    ends = pairs.select(F.col("a").alias("ball")).unionByName(pairs.select(F.col("b").alias("ball"))).distinct().join(balls, "ball")
    alone = ends.where(~F.col("many")).select(F.col("ball").alias("key"))
    middles = centres.select(name.alias("ball"), F.col("centre").alias("x")).unionByName(_vectors(rows, alone).select(F.col("key").alias("ball"), "x"))
    ends = materialize(ends.join(middles, "ball"), "ends")
    sides = [ends.select(*[F.col(c).alias(f"{c}_{s}") for c in ends.columns]) for s in "ab"]
    seen = pairs.join(sides[0], F.col("a") == F.col("ball_a")).join(sides[1], F.col("b") == F.col("ball_b")).where(F.size("x_a") == F.size("x_b"))
    cosine = dot(F.col("x_a"), F.col("x_b")) / (norm(F.col("x_a")) * norm(F.col("x_b")))
    apart = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("cosine"))))
    reach = F.col("radius_a") + F.col("radius_b")
    state = (F.when(~F.col("many_a") & ~F.col("many_b"), F.when(F.col("cosine") >= least, "all").otherwise("none"))
             .when(F.col("apart") + reach <= allowed - MARGIN, "all").when(F.col("apart") - reach > allowed + MARGIN, "none").otherwise("some"))
    judged = materialize(seen.withColumn("cosine", cosine).withColumn("apart", apart).withColumn("state", state).where("state <> 'none'").select(
        "a", "b", "state", "n_a", "n_b", "copies_a", "copies_b"), "judged")

    # Members of the pairs that are not settled, tile against tile.
    open_pairs = judged.where("state = 'some'").select("a", "b", F.ceil(F.col("n_a") / tile).cast("int").alias("ta"), F.ceil(F.col("n_b") / tile).cast("int").alias("tb"))
    needed = open_pairs.select(F.col("a").alias("ball")).unionByName(open_pairs.select(F.col("b").alias("ball"))).distinct()
    people = member.join(needed, "ball", "left_semi").select("key", "ball", "copies")
    people = materialize(people.join(_vectors(rows, people), "key"), "compared")

    def dealt(end: str, mine: str, theirs: str, side: int) -> DataFrame:
        own = F.pmod(F.xxhash64("key"), F.col(mine)).cast("int")
        both = people.join(open_pairs, F.col("ball") == F.col(end)).select(
            "a", "b", F.lit(side).alias("side"), "key", "copies", "x", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)).alias("far"))
        i, j = ("own", "far") if side == 0 else ("far", "own")
        return both.select("a", "b", F.col(i).alias("i"), F.col(j).alias("j"), "side", "key", "copies", "x")

    found = dealt("a", "ta", "tb", 0).unionByName(dealt("b", "tb", "ta", 1)).groupBy("a", "b", "i", "j").applyInPandas(
        lambda frame: _compare(frame, least), "key binary, a binary, b binary, more long")
    found = materialize(found, "found")

    # Links of each class: its ball, the balls wholly linked to it, single members of others.
    whole = judged.where("state = 'all'")
    to_ball = whole.select(F.col("a").alias("ball"), F.col("copies_b").alias("more")).unionByName(
        whole.select(F.col("b").alias("ball"), F.col("copies_a").alias("more"))).groupBy("ball").agg(F.sum("more").alias("by_ball"))
    to_member = found.groupBy("key").agg(F.sum("more").alias("by_member"))
    links = whole.select("a", "b").unionByName(found.select("a", "b").distinct())
    roots = components(links)
    counted = materialize(
        member.select("key", "least", "ball").join(balls.select("ball", "copies"), "ball").join(to_ball, "ball", "left").join(to_member, "key", "left")
        .join(roots.withColumnRenamed("node", "ball"), "ball", "left")
        .select("key", "least", F.coalesce("root", "ball").alias("root"),
                (F.col("copies") - 1 + F.coalesce("by_ball", F.lit(0)) + F.coalesce("by_member", F.lit(0))).alias("n_links")), "counted")
    smallest = counted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = counted.join(smallest, "root").select("key", "n_links", "component_id")
    out = signed.where(F.col("key").isNotNull()).select("vec_id", "key").join(named, "key").select("vec_id", "n_links", "component_id").unionByName(
        signed.where(F.col("key").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
