"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

The vectors are cut into blocks. In a block every dimension has posting segments: the
rows whose value falls into one step of a coarse scale. A segment's impact for a query
is its step times the query's value, over the least any row has in that dimension. A
batch of queries takes the segments by falling impact (the largest for any query of the
batch) and adds each query's impact to the scores of the segment's rows. What is still
open bounds what any row can gain, so processing stops once, for every query of the
batch, the rows that can still be among the k best are few, and never without that
proof; these rows are then scored exactly.

Defined cases: vectors that are null or hold a null or non-finite component take no
part, neither as query nor as candidate; missing trailing components count as 0; an
empty vector scores 0; ties go to the smaller id; of repeated query ids one row asks
(the smallest vector), while repeated candidate rows count each; a query's own id is
never its candidate; other columns are not looked at.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from palaver.session import materialize

from .common import slices_for


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """id, v: valid vectors as floor(scale * x)."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    valid = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(valid & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


class Segments:
    """Posting segments of one block of integer vectors."""

    def __init__(self, matrix: np.ndarray, steps: int = 32):
        self.matrix = matrix
        n, d = matrix.shape
        spread = int(matrix.max() - matrix.min()) + 1 if matrix.size else 1
        self.width = max(1, -(-spread // steps))
        levels = matrix // self.width
        self.rows = np.argsort(levels, axis=0, kind="stable").T.reshape(-1)  # rows by level, dimension after dimension
        ordered = np.sort(levels, axis=0, kind="stable").T.reshape(-1)
        dims = np.repeat(np.arange(d), n)
        new = np.ones(len(ordered), bool)
        new[1:] = (np.diff(ordered) != 0) | (np.diff(dims) != 0)
        self.start = np.flatnonzero(new)
        self.stop = np.append(self.start[1:], len(ordered))
        self.level, self.dim = ordered[self.start], dims[self.start]
        self.first = np.flatnonzero(np.diff(self.dim, prepend=-1))  # each dimension's first segment
        self.low, self.high = (levels.min(0), levels.max(0)) if n else (np.zeros(d, np.int64), np.zeros(d, np.int64))

    def possible(self, queries: np.ndarray, allowed: np.ndarray, k: int, enough: int,
                 checks: tuple[float, ...] = (0.6, 0.75, 0.85, 0.92, 0.96, 1.0)) -> tuple[np.ndarray, int]:
        """Rows x queries: which allowed rows can be among the k best of a query; and how many segments it took.

        ``checks``: after which shares of the segments the proof is tried.
        """
        n, d = self.matrix.shape
        q = queries.astype(np.int64) * self.width
        least = np.minimum(q * self.low, q * self.high)
        impact = q.T[self.dim] * self.level[:, None] - least.T[self.dim]  # segments x queries, never negative
        slack = np.abs(queries).sum(1) * (self.width - 1)  # what values lose by the coarse scale
        order = np.argsort(-impact.max(1), kind="stable") if d and len(queries) else np.empty(0, np.int64)
        score, still_open, at = np.zeros((n, len(queries)), np.int64), np.ones(len(order), bool), 0
        can = allowed
        for share in checks if len(order) else ():
            stop = int(np.ceil(share * len(order)))
            for s in order[at:stop].tolist():
                score[self.rows[self.start[s]: self.stop[s]]] += impact[s]
            still_open[order[at:stop]] = False
            at = stop
            # The most a row can gain: in each dimension the best segment that is still open.
            best = np.where(still_open[:, None], impact, 0)
            gain = np.maximum.reduceat(best, self.first, axis=0).sum(0)
            if n > k:
                # A row's true score lies within score .. score + gain + slack, up to one shift common to all rows.
                floor = np.partition(np.where(allowed, score, -1), n - k, axis=0)[n - k]
                can = allowed & (score + gain + slack >= floor)
            if can.sum(0).max() <= max(k, enough):
                break
        return can, at


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _search(group: pd.DataFrame, k: int, enough: int) -> pd.DataFrame:
    """Best candidates of one block for one block of queries."""
    asks, rows = group[group["asks"]], group[~group["asks"]]
    width = max((len(v) for v in group["v"]), default=0)
    index, ids = Segments(_matrix(rows["v"], width)), rows["id"].to_numpy()
    out, queries, names = [], _matrix(asks["v"], width), asks["id"].to_numpy()
    can, _ = index.possible(queries, ids[:, None] != names[None, :], k, enough)
    for i, query_id in enumerate(names):
        found = np.flatnonzero(can[:, i])
        score = index.matrix[found] @ queries[i]
        first = np.lexsort((ids[found], -score))[:k]
        out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[found][first], "score": score[first]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, block_rows: int = 1024, query_rows: int = 256, enough: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query.

    Queries are the rows whose id is divisible by ``every``. Each block of queries
    meets each block of vectors in one task.
    """
    rows = materialize(integers(vectors), "vectors")
    asks = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    counts = rows.agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("id") % every == 0, F.col("id"))).alias("q")).first()
    n_blocks, q_blocks = slices_for(counts["n"], block_rows), slices_for(counts["q"], query_rows)
    cut = F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)).cast("int")
    left = rows.select("id", "v", F.lit(False).alias("asks"), cut.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("part"))
    right = asks.select("id", "v", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
                        F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int").alias("part"))
    found = left.unionByName(right).groupBy("block", "part").applyInPandas(
        lambda g: _search(g, k, enough), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))
