"""Exact nearest neighbours by cosine distance without comparing all pairs.

Vectors fall into the cell of their nearest pivot. A first pass inside blocks of a cell
bounds each row's k-th distance; the triangle inequality then names the only cells that
can hold a closer row. Blocks of near cells form groups of queries: one task holds the rows of
a group with their k + 1 best so far, and the rows of the named cells pass it as a stream, so a
task's memory depends on neither the number of rows nor that of cells, and nothing but the
neighbours themselves comes out. Equal vectors are searched once: of any group of copies only
the first k + 1 ids can be among k neighbours.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import unit
from ..session import materialize
from .topk import seeded_order, top_per_group

MAX_PIVOTS = 1024
BLOCK = 1024
GROUPS, GROUP_ROWS = 48, (1024, 16384)  # groups of queries wanted, and the rows a group may have
SLACK = 1e-4  # covers distances that round to the same value
DIGITS = 9
SLACK_OF_ROUNDING = 2e-9


def _euclid(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances between unit vectors."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ y.T), 0.0))


def _line(centre: np.ndarray, cells: np.ndarray) -> list[int]:
    """Cells in an order that keeps near ones together: halves along the longest axis, again and again."""
    if len(cells) < 3:
        return [int(c) for c in cells]
    x = centre[cells] - centre[cells].mean(0)
    along = np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")
    half = len(cells) // 2
    return _line(centre, cells[along[:half]]) + _line(centre, cells[along[half:]])


class _Best:
    """The ``top`` nearest rows of each query so far, ties to the smaller id; closer rows wait and are merged now and then."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, top: int):
        self.ids, self.x, self.top = ids, x, top
        self.limit = np.full(len(x), np.inf)
        self.held = (np.zeros(0, int), np.zeros(0), ids[:0])
        self.waiting: list[tuple] = []
        self.pending, self.seen = 0, 0

    def meet(self, ids: np.ndarray, rows: np.ndarray) -> None:
        at = 0
        while at < len(rows):
            size = min(max(64, self.seen // 2), BLOCK)  # while few rows were seen, most of the next ones are among the best
            raw = 1.0 - self.x @ rows[at:at + size].T
            query, row = np.nonzero(raw <= (self.limit + SLACK_OF_ROUNDING)[:, None])
            self.waiting.append((query, np.maximum(np.round(raw[query, row], DIGITS), 0.0) + 0.0, ids[at + row]))
            self.pending += len(query)
            self.seen, at = self.seen + raw.shape[1], at + size
            if self.pending > len(self.x) * self.top:
                self.merge()

    def merge(self) -> None:
        query, dist, near = (np.concatenate(part) for part in zip(self.held, *self.waiting))
        order = np.lexsort((near, dist, query))
        query, dist, near = query[order], dist[order], near[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.top
        self.held = (query[keep], dist[keep], near[keep])
        last = place == self.top - 1
        self.limit[query[last]] = dist[last]
        self.waiting, self.pending = [], 0

    def frames(self):
        self.merge()
        query, dist, near = self.held
        for at in range(0, len(query), 1 << 16):
            some = slice(at, at + (1 << 16))
            yield pd.DataFrame({"rep": self.ids[query[some]], "near": near[some], "dist": dist[some]})


def nearest_neighbours(vectors: DataFrame, k: int = 50, id_col: str = "id", vector: str = "embedding",
                       pivots: int | None = None, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """(src, dst, rank, dist): the k nearest rows of each row, itself excluded.

    Distances are kept to nine digits; equal ones are ordered by id.
    """
    rows = materialize(
        vectors.select(F.col(id_col).alias("id"), unit(F.col(vector)).alias("u")).where(F.col("u").isNotNull()), "units")
    reps = rows.groupBy("u").agg(F.min("id").alias("rep"))
    members = materialize(rows.join(reps, "u").select("id", "rep"), "members")
    points = materialize(reps, "points")
    n = points.count()
    if n == 0:
        return members.selectExpr("id src", "id dst", "1 rank", "0D dist").limit(0)
    # Cells of a few times k rows: a row's own cell then bounds its k-th distance.
    chosen = points.orderBy(*seeded_order(seed, "rep")).limit(pivots or int(min(max(1, n // (4 * (k + 1))), MAX_PIVOTS))).collect()
    centre = np.array([r["u"] for r in chosen])

    @F.pandas_udf("cell int, gap double")
    def locate(u: pd.Series) -> pd.DataFrame:
        if u.empty:
            return pd.DataFrame({"cell": pd.Series([], dtype="int32"), "gap": pd.Series([], dtype=float)})
        d = _euclid(np.stack(u.to_numpy()), centre)
        cell = d.argmin(1)
        return pd.DataFrame({"cell": cell.astype("int32"), "gap": d[np.arange(len(d)), cell]})

    placed = materialize(points.withColumn("at", locate("u")).select("rep", "u", "at.cell", "at.gap"), "placed")
    sizes = {r["cell"]: (r["n"], r["radius"]) for r in placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).collect()}  # one row per pivot
    radius = np.array([sizes.get(c, (0, -np.inf))[1] for c in range(len(centre))])
    counts = np.array([sizes.get(c, (0, 0.0))[0] for c in range(len(centre))])
    parts = F.element_at(F.array(*[F.lit(int(-(-sizes.get(c, (1, 0))[0] // block))) for c in range(len(centre))]), F.col("cell") + 1)
    rep_type = dict(placed.dtypes)["rep"]
    between = _euclid(centre, centre)
    filled = [c for c in _line(centre, np.arange(len(centre))) if counts[c]]
    blocked = [(c, b, counts[c] / -(-counts[c] // block)) for c in filled for b in range(int(-(-counts[c] // block)))]
    group_rows = min(max(n // GROUPS, GROUP_ROWS[0]), GROUP_ROWS[1])
    ends = np.cumsum([size for *_, size in blocked])
    named = [(c, b, int((end - 1) // group_rows)) for (c, b, _size), end in zip(blocked, ends)]
    spark = vectors.sparkSession
    groups = spark.createDataFrame(named, "cell int, block long, grp int")
    placed = materialize(placed.withColumn("block", F.pmod(F.xxhash64("rep"), parts).cast("long")).join(groups, ["cell", "block"]).select(
        "grp", "cell", "block", "rep", "u"), "grouped")

    def route(frame: pd.DataFrame) -> pd.DataFrame:
        """The cells that may hold a neighbour of a row of one block."""
        cell, x = int(frame["cell"].iloc[0]), np.stack(frame["u"].to_numpy())
        to_pivot = _euclid(x, centre)
        # All rows of a cell lie within pivot distance + radius: the nearest cells with k + 1 rows give a finite bound.
        reach = np.where(counts > 0, to_pivot + radius[None, :], np.inf)
        order = np.argsort(reach, axis=1, kind="stable")
        enough = (np.cumsum(counts[order], axis=1) > k).argmax(1)
        bound = np.take_along_axis(reach, order, 1)[np.arange(len(x)), enough] if counts.sum() > k else np.full(len(x), np.inf)
        if len(x) > k:
            bound = np.minimum(bound, np.partition(_euclid(x, x), k, axis=1)[:, k])
        low = to_pivot - radius[None, :]
        apart = between[cell][None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (to_pivot ** 2 - to_pivot[:, [cell]] ** 2) / (2 * apart)
        low = np.maximum(low, np.where(apart > 0, plane, 0.0))
        needed = (radius >= 0) & (low <= bound[:, None] + SLACK).any(0)
        near = np.flatnonzero(needed)
        return pd.DataFrame({"grp": np.full(len(near), frame["grp"].iloc[0]), "cell": near, "gap": between[cell][near]})

    wanted = placed.groupBy("cell", "block").applyInPandas(route, "grp int, cell int, gap double").groupBy("grp", "cell").agg(
        F.min("gap").alias("gap"))
    strangers = wanted.join(placed.select("cell", "rep", "u", F.col("grp").alias("home")), "cell").where("home <> grp").select("grp", "gap", "rep", "u")
    stream = placed.select("grp", F.lit(-1.0).alias("gap"), "rep", "u").unionByName(strangers)

    def search(batches):
        """One group after another: its own rows come first, then all others by the distance of their cells."""
        now, own, best = None, [], None

        def rows_of(frame):
            return np.asarray(frame["rep"].tolist()), np.stack(frame["u"].to_numpy())

        def started():
            ids, x = (np.concatenate(part) for part in zip(*own))
            found = _Best(ids, x, k + 1)
            found.meet(ids, x)
            return found

        for batch in batches:
            for grp, frame in batch.groupby("grp", sort=True):
                if grp != now:
                    if own:
                        yield from (best or started()).frames()
                    now, own, best = grp, [], None
                mine = (frame["gap"] < 0).to_numpy()
                if mine.any():
                    own.append(rows_of(frame[mine]))
                if not mine.all():
                    best = best or started()
                    best.meet(*rows_of(frame[~mine]))
        if own:
            yield from (best or started()).frames()

    near = stream.repartition(4 * (named[-1][2] + 1), "grp").sortWithinPartitions("grp", "gap").mapInPandas(
        search, f"rep {rep_type}, near {rep_type}, dist double")
    same = F.col("rep") == F.col("near")
    near = materialize(near.withColumn("dist", F.when(same, 0.0).otherwise(F.col("dist"))), "near")
    heads = top_per_group(members, ["rep"], [F.asc("id")], k + 1).select(F.col("rep").alias("near"), F.col("id").alias("dst"))
    lists = top_per_group(near.join(heads, "near"), ["rep"], [F.asc("dist"), F.asc("dst")], k + 1).drop("rank", "near")
    pairs = members.withColumnRenamed("id", "src").join(lists, "rep").where(F.col("src") != F.col("dst"))
    return top_per_group(pairs, ["src"], [F.asc("dist"), F.asc("dst")], k).select("src", "dst", "rank", "dist")
