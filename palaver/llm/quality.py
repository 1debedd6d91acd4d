"""Quality rules: counts of a text and its distance from its language's profile.

Method: every document gives two histograms, one of character classes and one of
common words. The profile of a language is the sum of the histograms of all documents
with that language value. A document whose Jensen-Shannon distance from the profile is
too large is rejected, provided the text is long enough for the histogram to mean
something. Everything is built from SQL functions.

Defined cases: a null text counts as empty (no words, base rule fails); a null language
has a profile of its own; the only document of a language equals its profile; repeated
rows are judged one by one; other columns are not looked at.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palaver.session import materialize

from .common import BLANKS, plain, whole

# Frequent function words of four languages, in order of the languages.
COMMON_WORDS = (
    "the of and to in is that for on with",
    "der die und den von zu das mit sich ist",
    "la de et les le des en est que pour",
    "la de que el en y los se las por",
)
WORDS = list(dict.fromkeys(w for line in COMMON_WORDS for w in line.split()))
#: One letter per common word, so that counting is a length difference of a short text.
LETTERS = [chr(0x41 + i) for i in range(len(WORDS))]
#: Character classes that are counted; the rest of a word's characters is a class of its own.
CLASSES = {"upper": "A-Z", "digit": "0-9", "symbol": "#*$%&|<>", "point": ".,;:!?'\"()-"}


def _only(text: Column, chars: str) -> Column:
    """Number of code points of ``text`` in a regular expression's character class."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: positions covered by a three-word window that occurs twice."""
    grams = F.when(F.col("n_words") >= 4, F.transform(
        F.sequence(F.lit(1), F.col("n_words").cast("int") - 2),
        lambda i: F.xxhash64(F.element_at("words", i), F.element_at("words", i + 1), F.element_at("words", i + 2)),
    )).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("grams", grams)
    ordered = F.sort_array("grams")
    df = df.withColumn("sorted", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), ordered)
                       .otherwise(F.array().cast("array<bigint>")))
    twice = F.array_distinct(F.filter(
        F.zip_with("sorted", F.slice("sorted", 2, F.greatest(F.size("sorted"), F.lit(1))), lambda a, b: F.when(a == b, a)),
        lambda g: g.isNotNull()))
    df = df.withColumn("twice", twice)
    few = F.filter(F.transform("grams", lambda g, i: F.when(F.array_contains("twice", g), i)), lambda i: i.isNotNull())
    pairs = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    many = F.flatten(F.zip_with(
        pairs, F.slice(pairs, 2, F.greatest(F.size("grams"), F.lit(1))),
        lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
    starts = (F.when(F.size("twice") == 0, F.array().cast("array<int>"))
              .when(F.size("twice") <= 48, few).otherwise(many))
    df = df.withColumn("starts", starts)
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.array(s, s + 1, s + 2))))
    return df.withColumn("n_repeat_words", F.size(covered).cast("long")).drop("grams", "sorted", "twice", "starts")


def measure(docs: DataFrame, *carry: str) -> DataFrame:
    """One row per document: the counts, ``classes`` and ``common`` (histograms)."""
    df = docs.select(*carry, F.col("lang"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("plain", plain(F.col("text")))
    df = df.withColumn("words", F.when(F.col("plain") == "", F.array().cast("array<string>")).otherwise(F.split("plain", " ")))
    df = df.withColumn("n_words", F.size("words").cast("long"))
    df = _repeat_words(df)
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    df = df.withColumn("rest", F.regexp_replace("plain", "[a-z \\x{80}-\\x{10FFFF}]+", ""))
    codes = F.create_map(*[F.lit(x) for pair in zip(WORDS, LETTERS) for x in pair])
    hits = F.transform(F.filter("words", lambda w: w.isin(*WORDS)), lambda w: codes[w])
    df = df.withColumn("codes", F.array_join(hits, "")).withColumn("n_codes", F.length("codes"))
    df = df.select(
        *carry, "lang", "n_words",
        (F.length("plain") - F.greatest(F.col("n_words") - 1, F.lit(0))).cast("long").alias("word_chars"),
        F.length("text").cast("long").alias("n_text"), (F.octet_length("plain") - F.length("plain")).cast("long").alias("wide"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.array(*[_only(F.col("rest"), chars).cast("long") for chars in CLASSES.values()]).alias("known"),
        F.concat(F.array(*[(F.col("n_codes") - F.length(F.replace("codes", F.lit(x)))).cast("long") for x in LETTERS]),
                 F.array(F.col("n_words") - F.col("n_codes"))).alias("common"))
    total = F.aggregate("known", F.col("wide"), lambda a, x: a + x)
    return df.select(
        *carry, "lang", "n_words", "word_chars", F.col("known")[list(CLASSES).index("symbol")].alias("n_symbols"),
        "n_dup_lines", "n_repeat_words",
        F.concat("known", F.array(F.col("wide"), F.col("n_text") - F.col("word_chars"),
                                  F.greatest(F.col("word_chars") - total, F.lit(0)))).alias("classes"), "common")


def profiles(measured: DataFrame) -> DataFrame:
    """Per language the share of every bin over all documents: lang, ref_classes, ref_common."""
    bins = F.concat(
        F.transform("classes", lambda n, i: F.struct(F.lit("c").alias("kind"), i.alias("bin"), n.alias("n"))),
        F.transform("common", lambda n, i: F.struct(F.lit("w").alias("kind"), i.alias("bin"), n.alias("n"))))
    sums = (measured.select("lang", F.explode(F.filter(bins, lambda x: x["n"] >= 0)).alias("b"))
            .groupBy("lang", "b.kind", "b.bin").agg(F.sum("b.n").alias("n")))

    def row(kind: str) -> Column:
        picked = F.array_sort(F.filter(F.collect_list(F.struct("kind", "bin", "n")), lambda x: x["kind"] == kind))
        return F.transform(picked, lambda x: x["n"])

    return sums.groupBy("lang").agg(row("c").alias("ref_classes"), row("w").alias("ref_common"))


def js_distance(left: Column, right: Column) -> Column:
    """Jensen-Shannon distance (base 2, from 0 to 1) of two histograms; an empty one gives 0."""
    def total(h: Column) -> Column:
        return F.aggregate(h, F.lit(0.0), lambda a, x: a + x)

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    a, b = total(left), total(right)
    shares = F.zip_with(F.transform(left, lambda x: x / a), F.transform(right, lambda x: x / b),
                        lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    divergence = F.aggregate(shares, F.lit(0.0), lambda s, x: s + 0.5 * (
        part(x["p"], (x["p"] + x["q"]) / 2) + part(x["q"], (x["p"] + x["q"]) / 2)))
    return F.when((a == 0) | (b == 0), 0.0).otherwise(F.sqrt(F.greatest(divergence, F.lit(0.0))))


def judge(docs: DataFrame, *carry: str, max_class: float = 0.3, max_common: float = 0.14,
          noise: float = 1.1, min_chars: int = 200, min_words: int = 50) -> DataFrame:
    """The verdict of every document, with its counts and distances.

    ``max_class`` and ``max_common``: largest accepted distance from the language's
    profile. A histogram of n words strays from its source by about 1 / sqrt(n), so the
    limit of the words is ``max_common + noise / sqrt(n)``. ``min_chars`` (in words) and
    ``min_words``: below these the distance is not applied.
    """
    measured = materialize(measure(docs, *carry), "quality")
    # Written, so that Spark knows its size (a row per language) and need not move the documents to it.
    ref = materialize(profiles(measured).withColumnRenamed("lang", "ref_lang"), "profiles")
    df = measured.join(ref, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    df = df.withColumn("class_distance", js_distance(F.col("classes"), F.col("ref_classes")))
    df = df.withColumn("common_distance", js_distance(F.col("common"), F.col("ref_common")))
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    odd = (((F.col("word_chars") >= min_chars) & (F.col("class_distance") > max_class))
           | ((F.col("n_words") >= min_words) & (F.col("common_distance") > max_common + noise / F.sqrt("n_words"))))
    return df.withColumn("kept", ~F.col("base_failed") & ~odd).select(
        *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "class_distance", "common_distance")


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The documents that pass, with all their columns.

    The verdict travels with the whole row, so equal ids or repeated rows cannot mix.
    """
    rows = whole(docs, text=F.col("text"), lang=F.col("lang"))
    return judge(rows, "whole", **limits).where("kept").select("whole.*")
