import re
from collections import Counter

from palaver.plans import graph as g, sessions as s

TEXTS = {1: "One two three one two", 2: "four", 3: "...", 4: "five six's seven eight nine ten"}
SAID = [("a", 1, ""), ("a", 2, " 😂"), ("a", 3, ""), ("a", 2, ""), ("a", 4, " 🎉🎉"), ("b", 4, "th"), ("b", 1, " 😂"), ("b", 4, ""), ("c", 2, ""), ("c", 1, ""), ("c", 1, "")]


def brute():
    out = {}
    for name in "abc":
        w = re.findall("[a-z']+", " ".join(TEXTS[k] + tail for n, k, tail in SAID if n == name).lower())
        out[name] = Counter(" ".join(w[i:i + n]) for n in (2, 3) for i in range(len(w) - n + 1))
    return out


def phrases(spark):
    rows = spark.createDataFrame([(n, i, i, k, tail) for i, (n, k, tail) in enumerate(SAID)], "session_id string, ts_utc long, msg_id long, text_key long, text_tail string")
    return s.running_phrases(rows, rows.select("session_id").distinct(), spark.createDataFrame(list(TEXTS.items()), "text_key long, text string"))


def test_phrases_of_sessions_without_a_list_of_them(spark):
    """A row a message with the grams across its border; a text of n words stands for its own 2 n - 3."""
    found, want = phrases(spark), brute()
    assert {(r.session_id, r.phrase): r["count"] for r in s.phrase_counts(found).collect()} == {(n, p): c for n, x in want.items() for p, c in x.items()}
    rows = found.messages.collect()
    assert len(rows) == len(SAID) - 1 and sum(r.inner + len(r.joint) for r in rows) == sum(sum(x.values()) for x in want.values())
    assert {r.text_tail for r in rows} == {"", "th"}  # tails without words do not make a text another one


def test_cluster_phrases_split_a_text_once(spark):
    want = brute()
    labels = spark.createDataFrame([("a", 0), ("b", 1), ("c", -1)], "id string, cluster_id int")
    counts = {0: want["a"], 1: want["b"]}
    everything = sum(want.values(), Counter())
    rows = [(c, p, n, everything[p] - n) for c, x in counts.items() for p, n in x.items()]
    totals = [(c, sum(x.values()), sum(everything.values()) - sum(x.values())) for c, x in counts.items()]
    best = g.log_odds(spark.createDataFrame(rows, "scope int, phrase string, count long, rest long"),
                      spark.createDataFrame(totals, "scope int, n_target long, n_background long"), 1, 4).withColumnRenamed("scope", "cluster_id")
    def key(df):
        return sorted((r.cluster_id, r["rank"], r.phrase, r["count"], round(r.score, 9)) for r in df.collect())
    split, inside = [], s.Phrases.inside
    try:
        s.Phrases.inside = lambda self, rows: split.append(rows.count()) or inside(self, rows)
        assert key(g.cluster_phrases(phrases(spark), labels, 1, 4)) == key(best)
    finally:
        s.Phrases.inside = inside
    assert split == [4]  # texts 1, 2 and 4, and 4 with the tail that makes another word: not the ten messages that say them
