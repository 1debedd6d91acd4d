"""Vector expressions on ``array<float>`` columns."""
from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from .expr import let


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, null when a side has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(v: Column) -> Column:
    """L2-normalised vector, null when it has no length."""
    return let(as_doubles(v), lambda d: let(norm(d), lambda n: F.when(n > 1e-9, F.transform(d, lambda x: x / n))))


def weighted_centroids(df: DataFrame, keys: list[str], vector: str, weight: str) -> DataFrame:
    """Unit-length weighted mean per key; sums run map-side, only one vector per key moves."""
    mean = Summarizer.metrics("mean").summary(F.col("_vec"), F.col("_w").cast("double"))["mean"]
    return (
        df.select(*keys, array_to_vector(as_doubles(F.col(vector))).alias("_vec"), F.col(weight).alias("_w"))
        .groupBy(*keys)
        .agg(mean.alias("_mean"), F.sum("_w").alias("weight"))
        .select(*keys, "weight", unit(vector_to_array("_mean")).alias("centroid"))
        .where(F.col("centroid").isNotNull())
    )
