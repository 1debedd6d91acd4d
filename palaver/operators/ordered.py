"""Ordered computations that never hold a whole group in one task.

A conversation may own a large part of all messages, so a window over
``PARTITION BY chat`` would be a single-task sort. The rows are cut into slices of
about equal row count at quantiles of (group, order): however many rows share one
group, day or instant, no slice is much larger than the others. Windows run inside
(group, slice); one summary row of each carries the missing context across slice
borders. The summary has one row per group and one more per slice.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

SLICE = "_slice"


def with_even_slice(df: DataFrame, keys: list[str], order: list[str], rows_each: int = 1 << 20) -> DataFrame:
    """Adds a slice number that rises with ``order`` inside each group of ``keys``.

    ``order`` must be unique in a group. Tables of at most ``rows_each`` rows are one
    slice; larger ones are range-partitioned and written, so that the borders, which
    come from a sample, stay the same for every later reader.
    """
    parts = max(1, -(-df.count() // rows_each))
    if parts == 1:
        return df.withColumn(SLICE, F.lit(0))
    return materialize(df.repartitionByRange(parts, *keys, *order).withColumn(SLICE, F.spark_partition_id()), "slices")


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str],
                  prefix: str = "prev_") -> DataFrame:
    """Adds ``prev_<column>``: the values on the preceding row of the group."""
    part = [*keys, SLICE]
    row = F.struct(*columns)
    inside = Window.partitionBy(*part).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(SLICE)
    carried = (
        df.groupBy(*part)
        .agg(F.max_by(row, F.struct(*order)).alias("_end"))
        .select(*part, F.lag("_end").over(across).alias("_carry"))
    )
    out = (
        df.withColumn("_first", F.row_number().over(inside) == 1)
        .withColumn("_before", F.lag(row).over(inside))
        .join(carried, part)
        .withColumn("_before", F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_before")))
    )
    for c in columns:
        out = out.withColumn(prefix + c, F.col("_before")[c])
    return out.drop("_first", "_before", "_carry")


def with_running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the running total of ``value`` up to and including each row of the group."""
    part = [*keys, SLICE]
    df = df.withColumn("_value", value)
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        df.groupBy(*part)
        .agg(F.sum("_value").alias("_total"))
        .select(*part, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        df.withColumn("_running", F.sum("_value").over(inside))
        .join(carried, part)
        .withColumn(name, F.col("_running") + F.col("_offset"))
        .drop("_value", "_running", "_offset")
    )


def with_rank(df: DataFrame, keys: list[str], order: list[Column], name: str, rows_each: int = 1 << 16) -> DataFrame:
    """Adds the row number (from 1) within ``keys`` by ``order``, which must be unique, without one task per group.

    Rows are range-partitioned and written; a row's number is its place in its range
    after the counts of the group's earlier ranges.
    """
    parts = max(1, -(-df.count() // rows_each))
    spread = materialize(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = spread.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    return spread.withColumn("_place", F.row_number().over(inside)).join(sizes, [*keys, "_part"]).withColumn(
        name, F.col("_place") + F.col("_before")).drop("_part", "_place", "_before")


def with_dense_id(df: DataFrame, order: str, name: str, width: int = 1 << 16) -> DataFrame:
    """Adds consecutive ids from 1 in the order of a unique long column, without one global sort task."""
    sliced = df.withColumn(SLICE, F.floor(F.col(order) / width)).withColumn("_all", F.lit(0))
    return with_running_sum(sliced, ["_all"], [order], F.lit(1), name).drop(SLICE, "_all")
