"""Top rows per group and seeded picks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key; each task keeps k candidates before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def seeded_order(seed: int, *columns: str) -> list[Column]:
    """A repeatable shuffle of rows by the md5 of seed and columns, the same in any engine; ties broken by the columns themselves."""
    return [F.md5(F.concat_ws(",", F.lit(seed), *[F.col(c) for c in columns])), *[F.col(c) for c in columns]]


def seeded_sample(df: DataFrame, k: int, seed: int, *columns: str) -> DataFrame:
    return df.orderBy(*seeded_order(seed, *columns)).limit(k)
