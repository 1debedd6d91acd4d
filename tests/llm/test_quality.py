import math
import re
from collections import Counter

import pytest

from palaver.llm import quality

from .helpers import ODD, docs, prose


def counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {p for i, g in enumerate(grams) if often[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def table(spark):
    rows = [(i, "the of and " * (i % 5) + prose(40 + 10 * i, i, 40 + i), "en", "s") for i in range(25)]
    rows += [(100, "a b c a b c\n\na b c a b c\n \nx", "en", "s"), (101, "x " * 400, "en", "s"), (102, " ".join(f"{w}$$$###" for w in prose(300, 5).split()), "en", "s"),
             (103, "a a a a", "en", "s"), (104, "ab\x0bcd\x0cef gh", "fr", "s"), (105, prose(30000, 9, 3000) + " " + prose(30000, 9, 3000), "en", "s")]
    return docs(spark, rows + rows[:1] + ODD)


def test_counts_equal_plain_code(spark):
    df = table(spark)
    texts = {r.doc_id: r.text for r in df.collect()}
    got = quality.judge(df, "doc_id").collect()
    assert len(got) == df.count()
    for r in got:
        want = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[102] and not kept[101] and kept[20] and not kept[901]


def test_distance_is_jensen_shannon(spark):
    def plain(p, q):
        p, q = ([x / sum(h) for x in h] for h in (p, q))
        kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b) if x)
        m = [(x + y) / 2 for x, y in zip(p, q)]
        return math.sqrt(max(0.0, kl(p, m) / 2 + kl(q, m) / 2))

    pairs = [([1, 2, 3], [3, 2, 1]), ([0, 5, 0], [5, 0, 0]), ([4, 4, 4], [4, 4, 4]), ([1, 0, 9], [0, 1, 9])]
    df = spark.createDataFrame(pairs, "p array<bigint>, q array<bigint>").select("p", "q", quality.js_distance(df_col("p"), df_col("q")).alias("d"))
    for r in df.collect():
        assert r.d == pytest.approx(plain(r.p, r.q), abs=1e-12)


def df_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_keep_good_keeps_rows_whole(spark):
    df = table(spark)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in df.collect()}


def test_empty_table(spark):
    assert quality.judge(docs(spark, []), "doc_id").count() == 0
