import random
import re

import numpy as np

from palaver.llm import neardup
from palaver.llm.graph import components

from .helpers import ODD, docs, prose


def shingle_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")) if w]
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows, percent=85):
    sets = [shingle_set(t) for _, t, _, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    least = {i: min((rows[j][0] for j in g if rows[j][0] is not None), default=None) for g in groups.values() for i in g}
    return sorted((str(rows[i][0]), len(sets[i]), str(least[i]), rows[i][0] == least[i]) for i in range(len(rows)))


def family(n, seed, words=80, edits=3):
    """Copies of copies: each changes a few words of an earlier one, so links form chains."""
    rng, out = random.Random(seed), [prose(words, seed).split()]
    for _ in range(n - 1):
        new = list(rng.choice(out))
        for _ in range(rng.randrange(edits + 1)):
            new[rng.randrange(len(new))] = f"e{rng.randrange(9999)}"
        out.append(new)
    return [" ".join(x) for x in out]


def table():
    texts = family(60, 1) + family(25, 2, 400, 12) + [prose(30, i) for i in range(100, 130)] + ["Same  text\nhere", "same text here", "a b c d e", "A B C D E f"]
    rng = random.Random(7)
    ids = rng.sample(range(1000), len(texts))
    rows = [(i, t, "en", "s") for i, t in zip(ids, texts)]
    return rows + rows[:2] + ODD + [(2000, "a null id", "en", "s")]


def test_groups_equal_all_pairs(spark):
    rows = table()
    for percent, places, bands in ((85, 256, 32), (80, 252, 36)):
        got = neardup.groups(docs(spark, rows), percent=percent, places=places, bands=bands)
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got.collect()) == brute(rows, percent)


def test_tiles_give_the_same_groups(spark):
    rows = table()
    got = neardup.groups(docs(spark, rows), tile=1000)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got.collect()) == brute(rows)


def test_keep_one_of_each_group(spark):
    rows = table()
    kept = neardup.keep_one(docs(spark, rows)).collect()
    want = {x for x in brute(rows) if x[3]}
    assert sorted(str(r.doc_id) for r in kept) == sorted(x[0] for x in want)
    assert kept[0].asDict().keys() == docs(spark, rows).first().asDict().keys()


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 150).astype(np.uint64)
        a, b = pool[:120], pool[30:]
        x, y = neardup.superminhash([a, b], 256)
        errors.append((x == y).mean() - 90 / 150)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < (0.6 * 0.4 / 256) ** 0.5  # less spread than independent hashes


def test_long_set_in_slices_has_the_same_signature():
    values = np.unique(np.random.default_rng(2).integers(0, 2**63, 3 * neardup.SLICE).astype(np.uint64))
    whole = neardup.superminhash([values], 64)
    halves = [neardup.superminhash([values[i:i + 5000]], 64) for i in range(0, len(values), 5000)]
    assert (whole == np.minimum.reduce(halves)).all()


def test_components_of_a_long_chain(spark):
    keys = [f"{x:08d}" for x in random.Random(3).sample(range(10**8), 500)]
    links = spark.createDataFrame([(a, b) for a, b in zip(keys, keys[1:])] + [("x", "y")], "a string, b string")
    found = {r.node: r.root for r in components(links, "string").collect()}
    assert {found[k] for k in keys} == {min(keys)} and found["y"] == "x"


def test_empty_table(spark):
    assert neardup.groups(docs(spark, [])).count() == 0


def test_keep_one_where_ids_are_shared_or_missing(spark):
    a, b = prose(200, 1), prose(200, 2)
    rows = [(7, a + " x", "en", "s"), (7, a + " y", "en", "s"), (7, b, "en", "s"), (9, b + " z", "en", "s")]
    rows += [(None, prose(200, 3) + f" v{i}", "en", "s") for i in range(3)] + [(None, prose(90, 4), "en", "s"), (7, "", "en", "s"), (None, None, "en", "s")]
    kept = [(r.doc_id, (r.text or "")[:40]) for r in neardup.keep_one(docs(spark, rows)).collect()]
    want = [(7, a[:40]), (7, b[:40]), (None, prose(200, 3)[:40]), (None, prose(90, 4)[:40]), (7, ""), (None, "")]
    assert sorted(kept, key=str) == sorted(want, key=str)
