"""Connected components of a link table: union-find in every task, then star contraction."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from palaver.session import materialize


class UnionFind(dict):
    """Parents by key; the smaller root wins."""

    def find(self, x):
        root = x
        while self.setdefault(root, root) != root:
            root = self[root]
        while self[x] != root:
            self[x], x = root, self[x]
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self[max(a, b)] = min(a, b)
        return True


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of one partition, contracted to (node, root)."""
    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch["a"], batch["b"]):
            sets.union(a, b)
    rows = [(x, sets.find(x)) for x in list(sets)]
    rows = [(x, r) for x, r in rows if x != r]
    yield pd.DataFrame(rows, columns=["a", "b"])


def components(links: DataFrame, kind: str = "binary") -> DataFrame:
    """node, root (smallest key reachable) of every node of ``links`` (a, b).

    Each round contracts every partition to a forest, then replaces every node by its
    smallest neighbour; it ends when no link is left between different nodes. With
    hashes as keys the number of nodes falls by a constant factor a round.
    """
    schema = f"a {kind}, b {kind}"
    links = materialize(links.select("a", "b").where("a != b").mapInPandas(_forest, schema), "links")
    members = None
    while True:
        # Each node's smallest neighbour, itself included; links between these targets remain.
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots")
        if members is None:
            members = up
        else:
            members = materialize(members.join(up.withColumnRenamed("node", "n").withColumnRenamed("root", "r"), F.col("root") == F.col("n"), "left")
                                  .select("node", F.coalesce("r", "root").alias("root")), "members")
        left = up.select(F.col("node").alias("a"), F.col("root").alias("x"))
        moved = (links.join(left, "a").select("x", "b")
                 .join(up.select(F.col("node").alias("b"), F.col("root").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
        links = materialize(moved.where("a != b").distinct().mapInPandas(_forest, schema), "links")
        if links.isEmpty():
            return members
