"""Distinctive phrases: n-gram counts and log-odds with a Dirichlet prior (Monroe et al. 2008)."""
from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as tx, timefn as tf
from ..operators.topk import top_per_group
from ..sources.raw import Tables, spoken_messages, with_text


def phrase_counts(texts: DataFrame, keys: list[str], text: str = "text", sizes: tuple[int, ...] = (2, 3),
                  repeated: bool = False) -> DataFrame:
    """n-grams per key, never across texts.

    Counted where the text is read, so no text is shuffled. Where most texts are
    ``repeated``, equal ones are gathered first, by hash, and tokenised once.
    """
    rows = texts.select(*keys, F.col(text).alias("_t"), F.lit(1).cast("long").alias("_k"))
    if repeated:
        rows = rows.groupBy(*keys, F.xxhash64("_t").alias("_h"), F.md5("_t").alias("_m")).agg(F.first("_t").alias("_t"), F.sum("_k").alias("_k"))
    grams = rows.select(*keys, "_k", F.explode(tx.ngrams(tx.found_words(F.col("_t")), sizes)).alias("phrase"))
    return grams.groupBy(*keys, "phrase").agg(F.sum("_k").alias("count"))


@F.pandas_udf(DoubleType())
def _ln(x: pd.Series) -> pd.Series:
    """Natural logarithm of the C library; numbers that have none give null.

    A scope that is its whole corpus has odds of exactly zero, so the order of its phrases is that of rounding errors.
    Spark's own logarithm rounds about one result in a hundred otherwise than the C library, which databases use.
    """
    return pd.Series([math.log(v) if v > 0 else None for v in x], dtype="float64")


def log_odds(target: DataFrame, totals: DataFrame, min_count: int = 5, limit: int = 50,
             prior: float = 10.0) -> DataFrame:
    """Best phrases per scope.

    ``target``: scope, phrase, count (in the scope), rest (in its background).
    ``totals``: scope, n_target, n_background over all phrases of either corpus.
    """
    y, x = F.col("count").cast("double"), F.col("rest").cast("double")
    n_t, n_b = F.col("n_target").cast("double"), F.col("n_background").cast("double")
    a = F.lit(prior) * (y + x) / (n_t + n_b)
    delta = _ln((y + a) / (n_t + prior - y - a)) - _ln((x + a) / (n_b + prior - x - a))
    score = delta / F.sqrt(F.lit(1.0) / (y + a) + F.lit(1.0) / (x + a))
    scored = target.where(F.col("count") >= min_count).join(totals.where("n_target > 0"), "scope").withColumn("score", score)
    return top_per_group(scored, ["scope"], [F.desc("score"), F.asc("phrase")], limit).select(
        "scope", "phrase", "count", "score", "rank")


def log_odds_within(counts: DataFrame, scope: str, min_count: int = 5, limit: int = 50) -> DataFrame:
    """Each scope of one corpus against the rest of the corpus.

    ``counts``: (scope column, phrase, count). The rest of a phrase is its corpus count less the
    scope's own, so no scope x phrase table is built.
    """
    whole = counts.groupBy("phrase").agg(F.sum("count").alias("all"))
    sums = counts.groupBy(F.col(scope).alias("scope")).agg(F.sum("count").alias("n_target"))
    total = counts.agg(F.sum("count")).scalar()
    totals = sums.withColumn("n_background", total - F.col("n_target"))
    kept = counts.where(F.col("count") >= min_count).join(whole, "phrase").select(
        F.col(scope).alias("scope"), "phrase", "count", (F.col("all") - F.col("count")).alias("rest"))
    return log_odds(kept, totals, min_count, limit)


def scoped_counts(star: Tables) -> DataFrame:
    """Phrase counts by side, year and named direct contact: one pass serves all signature scopes."""
    named = star["persons"].where(~F.col("display_name").like("urn:%")).select("person_id", F.lit(True).alias("named"))
    rows = (
        with_text(star).where(F.char_length(F.trim("text")) > 0)
        .select(F.trim("text").alias("text"), "is_from_me", "chat_id", "person_id", tf.year_label(F.col("ts_local")).alias("year"))
        .join(star["chats"].select("chat_id", "is_group"), "chat_id").join(named, "person_id", "left")
        .withColumn("pair", F.when(~F.col("is_group") & F.col("named"), F.col("person_id")).otherwise(0))
    )
    return phrase_counts(rows, ["is_from_me", "year", "pair"], repeated=True)


def signature_phrases(counts: DataFrame, star: Tables, top_pairs: int = 20) -> DataFrame:
    """Owner against others, each year of the owner against the other years, each contact against everything else.

    The three scopes score against different corpora: everything, the owner's phrases, everything.
    """
    own = counts.where("is_from_me")
    everything = counts.groupBy("phrase").agg(F.sum("count").alias("all"))
    mine_all = own.groupBy("phrase").agg(F.sum("count").alias("all"))
    n_all, n_mine = counts.agg(F.sum("count")).scalar(), own.agg(F.sum("count")).scalar()

    def scored(target: DataFrame, corpus: DataFrame, total: Column, min_count: int, limit: int) -> DataFrame:
        totals = target.groupBy("scope").agg(F.sum("count").alias("n_target")).withColumn(
            "n_background", total - F.col("n_target"))
        rest = target.where(F.col("count") >= min_count).join(corpus, "phrase").withColumn("rest", F.col("all") - F.col("count"))
        return log_odds(rest, totals, min_count, limit)

    def scope_counts(rows: DataFrame, scope: Column) -> DataFrame:
        return rows.groupBy(scope.alias("scope"), "phrase").agg(F.sum("count").alias("count"))

    you = scored(scope_counts(own, F.lit("you")), everything, n_all, 8, 25)
    years = scored(scope_counts(own, F.concat(F.lit("year:"), F.col("year"))), mine_all, n_mine, 5, 15)
    volume = (
        spoken_messages(star).groupBy("chat_id", "person_id").agg(F.count(F.lit(1)).alias("n"))
        .join(star["chats"].where(~F.col("is_group")).select("chat_id"), "chat_id", "left_semi")
        .join(star["persons"].where(~F.col("display_name").like("urn:%")), "person_id")
        .groupBy("person_id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "person_id").limit(top_pairs)
    )
    chosen = counts.where("pair > 0").join(volume.select(F.col("person_id").alias("pair")), "pair", "left_semi")
    pairs = scored(scope_counts(chosen, F.concat(F.lit("person:"), F.col("pair").cast("string"))), everything, n_all, 4, 15)

    names = star["persons"].select(F.concat(F.lit("person:"), F.col("person_id").cast("string")).alias("scope"), "display_name")
    label = F.when(F.col("scope") == "you", F.lit("You")).when(
        F.col("scope").startswith("year:"), F.substring("scope", 6, 4)).otherwise(F.col("display_name"))
    return you.unionByName(years).unionByName(pairs).join(names, "scope", "left").select(
        "scope", label.alias("label"), "phrase", "count", "score", "rank")
