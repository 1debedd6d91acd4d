import random
import re
import zlib
from collections import Counter

import pytest

from palaver.llm import spelling

from .helpers import ODD, docs, prose

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits(a, b):
    """Edit distance by the plain table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows):
    counts = Counter()
    for doc, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [o for o in n if abs(len(o) - len(w)) < 2 and edits(o, w) == 1] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def variants(seed, words):
    """Texts of few words and many misspellings of them, so that chains of forms arise."""
    rng = random.Random(seed)
    letters = "abcdeéÀÿst"
    pool = []
    for w in words:
        for _ in range(12):
            i = rng.randrange(len(w))
            pool += [w] * rng.choice((1, 3, 9)) + [w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]] * rng.choice((1, 2, 3))
            w = pool[-1]
    rng.shuffle(pool)
    return [" ".join(pool[i: i + 200]) for i in range(0, len(pool), 200)]


def test_equal_to_plain_search(spark):
    texts = variants(1, ["sentence", "Grammar", "étudiant", "straße", "letters", "aaaaa", "stsst"]) + [prose(300, 2)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + ODD
    got = spelling.variants(docs(spark, rows)).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(set(got)) > 50
    assert any(r.form and r.root != r.form for r in got)


def test_branches_in_pieces_and_long_words(spark):
    long = ["b" * 70, "b" * 69, "b" * 69 + "c", "c" + "b" * 69, "d" * 47, "d" * 48, "d" * 49, "d" * 47 + "e", "e" + "d" * 47, "bbbbbbcb" * 600, "bbbbbbcb" * 600 + "c"]
    texts = variants(3, ["tests", "toast", "taste"]) + [" ".join(long * 3), " ".join(long[::2] * 9)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    known = spelling.words(docs(spark, rows))
    whole = sorted(map(tuple, spelling.near_words(known).collect()))
    assert whole == sorted(map(tuple, spelling.near_words(known, prefix=2, piece=7).collect())) == sorted(map(tuple, spelling.near_words(known, prefix=6, piece=3).collect()))
    assert {tuple(r) for r in spelling.variants(docs(spark, rows)).collect()} == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "apple appla apple", "en", "s")] * 4
    got = {tuple(r) for r in spelling.variants(docs(spark, rows)).collect()}
    assert got == brute(rows) == {("apple", None, "apple", 8, 1, None), ("appla", "apple", "apple", 4, 1, 8)}
    assert spelling.variants(docs(spark, [])).count() == 0


@pytest.mark.parametrize("a, b, near", [("abc", "abd", True), ("abc", "ab", True), ("ab", "cab", True), ("abc", "acb", False), ("abcd", "ab", False), ("aab", "ab", True)])
def test_one_edit(a, b, near):
    assert spelling.one_edit(a.encode(), b.encode()) is near


def test_search_equal_to_all_pairs():
    rng = random.Random(5)
    stored = sorted({"".join(rng.choice("abet") for _ in range(rng.randrange(4, 8))) for _ in range(600)})
    trie = spelling.Trie([w.encode() for w in stored])
    asked = [w.encode() for w in stored[::3]]
    q, s = trie.search(asked, __import__("numpy").zeros(len(asked), bool))
    got = sorted((asked[i], trie.words[j]) for i, j in zip(q, s))
    assert got == sorted((a, b.encode()) for a in asked for b in stored if edits(a.decode(), b) == 1)
