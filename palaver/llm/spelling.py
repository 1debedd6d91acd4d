"""Spelling variants: words one edit apart, found with a frequency-vector trie.

A word's frequency vector counts its letters by group. One inserted or deleted letter changes one count
by one, one replaced letter moves one count up and one down (or none). A trie arranges words by successive counts;
a depth-first search goes down with a budget of one surplus and one deficit. It carries
all queries of a batch at once and drops a query where its budget is spent. The words of a leaf are verified
against the query letter by letter.

How it runs: the counts of the first ``prefix`` groups name a branch of the trie. Every word is stored in its own branch,
and asks there and in each branch the budget reaches; a pair is found once, from the side with the larger counts. A branch
of more than ``piece`` words is dealt to several tasks by hash, each with its share of the stored words and
all queries, which pass as a stream. Tasks return per word the number of near words and the best one, no pairs.

Defined cases: null and empty texts hold no words; a null id counts as an empty one; a text's length does not matter
(its words are rows), long words are compared one by one; ties take the smallest word in code-point order; repeated rows
count again; other columns are not looked at; an empty table gives an empty result.
"""
from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from palaver.session import materialize

from .common import ascii_lower

RUNS = r"[A-Za-zÀ-ÿ]+"
#: Letter groups, frequent letters alone; what is not listed (accented and upper-case letters) is the last group.
GROUPS = ("e", "a", "i", "n", "o", "r", "t", "s", "u", "h", "l", "d", "cmp", "vgbf", "wykjxqz")
N_GROUPS = len(GROUPS) + 1
GROUP_OF = np.full(256, N_GROUPS - 1, np.int64)
for _number, _letters in enumerate(GROUPS):
    for _letter in _letters:
        GROUP_OF[ord(_letter)] = _number
#: Letters compared at once; longer words are verified one by one.
WIDE = 48


def words(docs: DataFrame, modulus: int = 97, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """word, n of the whole table: lower-cased letter runs, one letter less where the checksum of id and run says so."""
    run = F.col("run")
    low = F.when(F.lower(run) == run, run).otherwise(ascii_lower(run))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(RUNS), F.lit(0))).alias("run"))
    coded = rows.select(low.alias("run"), F.crc32(F.concat("doc", F.lit(":"), low).cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    out = coded.select(F.when(F.col("h") % modulus == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_length)
    return out.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def letters(found: list[bytes]) -> np.ndarray:
    """Code points of each word in a row, 0 behind the end; words over WIDE letters are cut here and verified apart."""
    return np.array([w[:WIDE] for w in found], dtype=f"S{WIDE}").view(np.uint8).reshape(len(found), WIDE)


def vectors(found: list[bytes]) -> np.ndarray:
    """Letters of every group in each word."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    codes = np.frombuffer(b"".join(found), np.uint8)
    owner = np.repeat(np.arange(len(found)), sizes)
    return np.bincount(owner * N_GROUPS + GROUP_OF[codes], minlength=len(found) * N_GROUPS).reshape(len(found), N_GROUPS)


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether two different words differ by one inserted, deleted or replaced letter."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == (b[i:] if len(a) > len(b) else b[i + 1:])


class Trie:
    """Words in the order of their frequency vectors: a node is a range of rows with equal counts so far."""

    LEAF = 24

    def __init__(self, stored: list[bytes]):
        counts = vectors(stored)
        order = np.lexsort(counts.T[::-1])
        self.words = [stored[i] for i in order]
        self.counts = counts[order].astype(np.int32)
        self.letters = letters(self.words)
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))

    def search(self, asked: list[bytes], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, stored) numbers of all pairs one edit apart; of queries marked ``own`` only pairs with a smaller stored word."""
        counts = vectors(asked).astype(np.int32)
        spelled, sizes = letters(asked), np.fromiter(map(len, asked), np.int64, len(asked))
        left, right = [], []
        everyone = np.arange(len(asked))
        stack = [(0, len(self.words), 0, everyone, np.zeros(len(asked), np.int8), np.zeros(len(asked), np.int8))]
        while stack:
            low, high, level, who, surplus, deficit = stack.pop()
            if not len(who):
                continue
            if high - low <= self.LEAF or level == N_GROUPS:
                for start in range(0, len(who), 4096):
                    mine = who[start: start + 4096]
                    off = self.counts[None, low:high, level:] - counts[mine, None, level:]
                    fits = (np.maximum(off, 0).sum(2) + surplus[start: start + 4096, None] <= 1) & (np.maximum(-off, 0).sum(2) + deficit[start: start + 4096, None] <= 1)
                    q, s = np.nonzero(fits)
                    if len(q):
                        q, s = mine[q], s + low
                        good = self._verify(asked, spelled, sizes, q, s)
                        left.append(q[good])
                        right.append(s[good])
                continue
            column = self.counts[low:high, level]
            borders = np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1, [high - low]])
            for x, y in zip(borders[:-1], borders[1:]):
                off = column[x] - counts[who, level]
                more, less = surplus + (off == 1), deficit + (off == -1)
                stay = (np.abs(off) <= 1) & (more <= 1) & (less <= 1)
                stack.append((low + x, low + y, level + 1, who[stay], more[stay], less[stay]))
        q = np.concatenate(left) if left else np.empty(0, np.int64)
        s = np.concatenate(right) if right else np.empty(0, np.int64)
        smaller = np.fromiter((not own[i] or self.words[j] < asked[i] for i, j in zip(q, s)), bool, len(q))
        return q[smaller], s[smaller]

    def _verify(self, asked: list[bytes], spelled: np.ndarray, sizes: np.ndarray, q: np.ndarray, s: np.ndarray) -> np.ndarray:
        a, b, na, nb = spelled[q], self.letters[s], sizes[q], self.sizes[s]
        same = a == b
        good = (na == nb) & ((~same).sum(1) == 1)
        # One letter more: the equal letters in front and, moved by one, behind cover the shorter word.
        for longer, shorter, size, pick in ((a, b, nb, na == nb + 1), (b, a, na, nb == na + 1)):
            rows = np.flatnonzero(pick)
            if len(rows):
                front = np.where(same[rows].all(1), WIDE, same[rows].argmin(1))
                shifted = longer[rows, 1:] == shorter[rows, :-1]
                place = np.arange(WIDE - 1)[None, :]
                behind = (shifted | (place < front[:, None]) | (place >= size[rows, None])).all(1)
                good[rows] = behind
        for i in np.flatnonzero((na > WIDE - 1) | (nb > WIDE - 1)):
            good[i] = asked[q[i]] != self.words[s[i]] and one_edit(asked[q[i]], self.words[s[i]])
        return good


def _routes(prefix: int) -> np.ndarray:
    """Changes of the first counts within the budget that lead to a branch not above the own one."""
    moves = [m for m in itertools.product((-1, 0, 1), repeat=prefix) if m.count(1) <= 1 and m.count(-1) <= 1]
    return np.array([m for m in moves if m <= (0,) * prefix])


def _send(batches: Iterator[pd.DataFrame], prefix: int) -> Iterator[pd.DataFrame]:
    """branch, role (1 asks at home, 2 elsewhere), word, n for each branch where a word asks."""
    routes = _routes(prefix)
    for batch in batches:
        head = vectors([w.encode("latin-1") for w in batch["word"]])[:, :prefix]
        for move in routes:
            goal = head + move
            rows = np.flatnonzero((goal >= 0).all(1))
            if len(rows):
                names = [",".join(map(str, g)) for g in goal[rows].tolist()]
                yield pd.DataFrame({"branch": names, "role": 2 if move.any() else 1, "word": batch["word"].to_numpy()[rows], "n": batch["n"].to_numpy()[rows]})


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by branch and piece, stored words (role 0) first: near words of each word, counted, with the best."""
    current, stored, counts, trie = None, [], [], None
    for batch in batches:
        start = 0
        keys = list(zip(batch["branch"], batch["piece"]))
        role, spelled, n = batch["role"].to_numpy(), [w.encode("latin-1") for w in batch["word"]], batch["n"].to_numpy()
        while start < len(batch):
            if keys[start] != current:
                current, stored, counts, trie = keys[start], [], [], None
            stop = start
            while stop < len(batch) and keys[stop] == current and (role[stop] == 0) == (role[start] == 0):
                stop += 1
            if role[start] == 0:
                stored += spelled[start:stop]
                counts += n[start:stop].tolist()
            elif stored:
                if trie is None:
                    trie = Trie(stored)
                    known = dict(zip(stored, counts))
                asked = spelled[start:stop]
                q, s = trie.search(asked, role[start:stop] == 1)
                best: dict[bytes, list] = {}
                for i, j in zip(q.tolist(), s.tolist()):
                    x, y = asked[i], trie.words[j]
                    for word, other, m in ((x, y, known[y]), (y, x, int(n[start + i]))):
                        mine = best.setdefault(word, [0, (1, b"")])
                        mine[0] += 1
                        mine[1] = min(mine[1], (-m, other))
                yield pd.DataFrame([(w.decode("latin-1"), k, -m, o.decode("latin-1")) for w, (k, (m, o)) in best.items()], columns=["word", "near", "top_n", "top"])
            start = stop


def near_words(known: DataFrame, prefix: int = 4, piece: int = 50_000) -> DataFrame:
    """word, n_near, top, top_n of every word of ``known`` (word, n) that has near words."""
    asks = known.mapInPandas(lambda it: _send(it, prefix), "branch string, role int, word string, n long")
    asks = materialize(asks, "asks")
    sizes = asks.where("role = 1").groupBy("branch").agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("pieces"))
    placed = asks.join(sizes, "branch")  # a branch that stores nothing answers nothing
    stored = placed.where("role = 1").select("branch", F.pmod(F.xxhash64("word"), "pieces").cast("int").alias("piece"), F.lit(0).alias("role"), "word", "n")
    asking = placed.select("branch", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "role", "word", "n")
    dealt = stored.unionByName(asking).repartition("branch", "piece").sortWithinPartitions("branch", "piece", "role", "word")
    found = dealt.mapInPandas(_near, "word string, near long, top_n long, top string")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("top_n")).alias("m"), F.col("top").alias("w"))).alias("b")).select(
        "word", "n_near", F.col("b.w").alias("top"), (-F.col("b.m")).alias("top_n"))


def variants(docs: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text)."""
    known = materialize(words(docs), "words")
    near = near_words(known)
    formed = F.col("top_n") >= ratio * F.col("n")
    rows = known.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("top")).alias("form"), F.when(formed, F.col("top_n")).alias("form_n"))
    rows = materialize(rows, "forms")
    # Counts double along a chain of forms, so it is short; pointers double, too.
    steps = materialize(rows.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = steps.select(F.col("word").alias("w"), F.col("root").alias("r"))
        further = materialize(steps.join(ahead, F.col("root") == F.col("w")).select("word", F.col("r").alias("root"), (F.col("r") != F.col("root")).alias("moved")), "roots")
        moved = not further.where("moved").isEmpty()
        steps = further.drop("moved")
        if not moved:
            break
    return rows.join(steps, "word").select("word", "form", "root", "n", "n_near", "form_n")
