"""Shared helpers: reading a table, words, stable hashes, loops over written tables."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def plain(text: Column) -> Column:
    """The words of a text with one blank between them; null gives an empty text."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))


def words_of(text: Column) -> Column:
    """Words of a text as an array; no word, no element."""
    words = plain(text)
    return F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(words, " "))


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of 64-bit numbers (three xor-shifts, two odd factors)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices_for(n_rows: int, rows_each: int) -> int:
    """Number of partitions that hold about ``rows_each`` rows."""
    return max(1, -(-n_rows // rows_each))


def whole(df: DataFrame, **named: Column) -> DataFrame:
    """Only the given columns and ``whole``, a struct of all the old ones, so that no name can clash."""
    return df.select(*[c.alias(n) for n, c in named.items()], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole"))


def replaced(df: DataFrame, like: DataFrame, text: Column) -> DataFrame:
    """The columns of ``like`` out of ``whole``, with another text and its length."""
    new = {"text": text, "n_chars": F.length(text)}
    fields = [new[f.name].cast(f.dataType).alias(f.name) if f.name in new else F.col(f"whole.`{f.name}`").alias(f.name) for f in like.schema.fields]
    return df.select(*fields)
