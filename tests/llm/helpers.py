"""Small tables for the operators' tests."""
from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, key string, size string, kept string, _row string"
PAGES = "page_id long, url string, html string, host string, rule string, digest string"


def docs(spark, rows):
    """Rows (doc_id, text, lang, source); the further columns clash with names used inside."""
    return spark.createDataFrame([(i, t, lang, s, len(t) if t else None, "w", "k", "s", "x", "r") for i, t, lang, s in rows], DOCS)


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "h", "r", "d") for i, u, h in rows], PAGES)


def prose(n: int, seed: int, vocabulary: int = 300) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [(None, "a null id", "en", "s"), (901, None, "en", "s"), (902, "", None, None), (903, "   \n\t ", "en", None), (904, "one", None, "s"), (905, "é ü ñ ♥ 𝒳", "fr", "s")]
