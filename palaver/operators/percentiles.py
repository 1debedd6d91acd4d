"""Exact interpolated percentiles by counting, for groups of any size.

The built-in exact percentile keeps every distinct value of a group in one task. Here the
values are counted, the counts are summed in coarse ranges, a running total over the ranges
finds the range that holds each wanted rank, and only the values of those ranges are ranked.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RANGE = 1 << 20


def exact_percentiles(df: DataFrame, keys: list[str], value: Column, probabilities: dict[str, float],
                      scale: float = 1.0) -> DataFrame:
    """One row per key with one double column per entry of ``probabilities``.

    ``value`` is an integer expression; the result is divided by ``scale``. Null values are ignored.
    """
    counts = (
        df.select(*keys, value.cast("long").alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_range", F.floor(F.col("_v") / RANGE))
    )
    running = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = (
        counts.groupBy(*keys, "_range").agg(F.sum("_n").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(running))
        .withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    )
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in probabilities.items()
    ]))
    position = F.col("_p.p") * (F.col("_all") - 1)
    targets = (
        ranges.withColumn("_p", wanted)
        .withColumn("_pos", position)
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
        .where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
        .select(*keys, "_range", F.col("_p.name").alias("_name"), "_pos", "_rank",
                (F.col("_rank") - (F.col("_upto") - F.col("_n"))).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    touched = targets.select(*keys, "_range").distinct()
    ranked = (
        counts.join(touched, [*keys, "_range"], "left_semi")
        .withColumn("_end", F.sum("_n").over(inside))
        .select(*keys, "_range", "_v", (F.col("_end") - F.col("_n")).alias("_start"), "_end")
    )
    hits = targets.join(ranked, [*keys, "_range"]).where(
        (F.col("_offset") >= F.col("_start")) & (F.col("_offset") < F.col("_end")))
    low = F.max(F.when(F.col("_rank") == F.floor("_pos"), F.col("_v"))).cast("double")
    high = F.max(F.when(F.col("_rank") == F.ceil("_pos"), F.col("_v"))).cast("double")
    share = F.max(F.col("_pos") - F.floor("_pos"))
    per_name = hits.groupBy(*keys, "_name").agg(((low + (high - low) * share) / scale).alias("_result"))
    return per_name.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_name") == name, F.col("_result"))).alias(name) for name in probabilities
    ])
