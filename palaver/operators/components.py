"""Connected components by minimum labels with hooking and shortcutting."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def connected_components(nodes: DataFrame, edges: DataFrame, keys: list[str] | None = None, max_rounds: int = 50) -> DataFrame:
    """(keys, id, component): the component is its smallest id. ``edges`` has columns a, b.

    With ``keys`` several graphs are labelled in one run. Each round hooks a label to the
    smallest label next to it and then follows labels once more, so long paths shrink in
    logarithmic rounds. Rounds end when no label changes.
    """
    keys = keys or []
    both = materialize(
        edges.select(*keys, F.col("a").alias("src"), F.col("b").alias("dst"))
        .unionByName(edges.select(*keys, F.col("b").alias("src"), F.col("a").alias("dst"))), "adjacency")
    labels = materialize(nodes.select(*keys, "id").withColumn("component", F.col("id")), "labels")
    for _ in range(max_rounds):
        around = both.join(labels.withColumnRenamed("id", "dst"), [*keys, "dst"]).groupBy(*keys, "src").agg(
            F.min("component").alias("low"))
        around = around.join(labels.withColumnRenamed("id", "src"), [*keys, "src"]).where(F.col("low") < F.col("component"))
        offers = around.select(*keys, F.col("src").alias("id"), "low").unionByName(
            around.select(*keys, F.col("component").alias("id"), "low"))
        best = offers.groupBy(*keys, "id").agg(F.min("low").alias("low"))
        hooked = labels.join(best, [*keys, "id"], "left").select(
            *keys, "id", F.least("component", F.coalesce("low", "component")).alias("component"), F.col("low").isNotNull().alias("moved"))
        hooked = materialize(hooked, "hooked")
        follow = hooked.select(*keys, F.col("id").alias("component"), F.col("component").alias("root"))
        labels = materialize(
            hooked.join(follow, [*keys, "component"]).select(*keys, "id", F.col("root").alias("component")), "labels")
        if hooked.where("moved").limit(1).count() == 0:
            return labels
    raise RuntimeError("components did not settle")
