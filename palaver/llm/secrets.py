"""Secret scan: fixed patterns, and a randomness battery with false-discovery control.

Patterns give the base spans. The battery looks at every further run of characters that
an encoding (hexadecimal, base 32, base 64) could have produced, and tests the run, its
parts between separators and each of these without separators, with the smallest alphabet
that fits, for being uniformly random over that alphabet: chi-squared of symbol counts, number of runs
above and below the middle symbol, and serial correlation. A run that no test rejects
may still be ordinary text by chance, the easier the shorter it is. So its p-value is
the chance that ordinary text of its length, drawn with the corpus's own symbol
frequencies, looks as uniform; and Benjamini-Hochberg's rule, per encoding and length
band over all these tests of all documents, decides which are reported as ``random``; of
overlapping ones the one with the least p-value.

Defined cases: null and empty texts have no spans; base spans are cut out
of runs and the rest is tested; runs shaped like one word (letters, at most the first a capital) or one
number are never candidates; of spans with equal p-values the longer, then the earlier stays; a very
long text is scanned in one pass, in time linear in its length but for the logarithm of its number of
base spans (a text lies in one task); repeated rows count as often as they occur; other columns
are not looked at.
"""
from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from palaver.session import materialize

from .common import replaced, whole

#: Base kinds in order; the battery's spans come after them.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A run that is not one word or one number.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])(?!(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?![A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]{16,}")
ALPHABETS = {
    "hex": "0123456789abcdef", "upperhex": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
SYMBOL = {name: np.full(128, -1, np.int64) for name in ALPHABETS}
for _name, _chars in ALPHABETS.items():
    SYMBOL[_name][[ord(c) for c in _chars]] = np.arange(len(_chars))
#: Characters that join groups of a key or words to it; ways to split a run at them.
SEPARATORS = "+/_-"
SPLITS = [re.compile(f"[{x}]+") for x in ("+/_\\-", "+/", "_\\-", "+", "/", "_", "\\-")]
PLAIN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|")
LEAST = 16
HIST = 128  # code points whose frequency in ordinary text is kept


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, in order."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def encoding_of(run: str) -> str | None:
    """The smallest alphabet that holds all of a run."""
    code = np.frombuffer(run.encode("ascii"), np.uint8)
    return next((name for name in ALPHABETS if (SYMBOL[name][code] >= 0).all()), None)


def candidates(text: str, start: int, stop: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, symbols) of a run, its parts between separators, these without words at their ends, and each without its separators."""
    seen = set()

    def spans() -> Iterator[tuple[int, int]]:
        yield start, stop
        for split in SPLITS:
            at = start
            for m in split.finditer(text, start, stop):
                yield at, m.start()
                at = m.end()
            yield at, stop

    def trimmed(s: int, e: int) -> tuple[int, int]:
        atoms = list(SPLITS[0].finditer(text, s, e))
        edges = [s, *[m.end() for m in atoms]], [*[m.start() for m in atoms], e]
        odd = [i for i, (a, b) in enumerate(zip(*edges)) if not PLAIN.fullmatch(text, a, b)]
        return (edges[0][odd[0]], edges[1][odd[-1]]) if odd else (s, s)

    for s, e in spans():
        if e - s < LEAST:
            continue
        for a, b in ((s, e), trimmed(s, e)):
            if b - a >= LEAST and (a, b) not in seen:
                seen.add((a, b))
                run = text[a:b]
                bare = run.translate({ord(c): None for c in SEPARATORS})
                if not PLAIN.fullmatch(run):
                    yield a, b, run
                if len(bare) != len(run) and len(bare) >= LEAST and not PLAIN.fullmatch(bare):
                    yield a, b, bare


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared by the cube-root normal approximation."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(symbols: np.ndarray, k: int) -> tuple[float, float, float]:
    """Statistic of uniformity and the p-values of the runs and the serial-correlation test."""
    n = len(symbols)
    counts = np.bincount(symbols, minlength=k)
    chi = float(k / n * (counts.astype(float) ** 2).sum() - n)
    upper = symbols >= k // 2
    n1 = int(upper.sum())
    n2 = n - n1
    if n1 and n2:
        mean = 1 + 2 * n1 * n2 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = _two_sided((1 + int((upper[1:] != upper[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        runs = 2.0 ** (1 - n)
    x = symbols - (k - 1) / 2
    serial = _two_sided(float((x[1:] * x[:-1]).sum()) / math.sqrt(n - 1) / ((k * k - 1) / 12))
    return chi, runs, serial


def _reach(base: list[tuple[int, int, int]]) -> list[int]:
    """How far the base spans reach, up to and with each of them; never falls, so a place in it is found by halving."""
    return list(accumulate((e for _, _, e in base), max))


def _between(start: int, stop: int, base: list[tuple[int, int, int]], reach: list[int]) -> list[tuple[int, int]]:
    """What the base spans (in order) leave of a run; only the spans that meet the run are looked at."""
    out, at = [], start
    for i in range(bisect.bisect_right(reach, start), len(base)):
        s, _, e = base[i]
        if s >= stop:
            break
        if e > at:
            out.append((at, s))
            at = e
    return [(a, b) for a, b in [*out, (at, stop)] if b - a >= LEAST]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per document its base spans and candidate runs with their statistics; per batch one row with the text's symbol counts."""
    for batch in batches:
        hist, rows = np.zeros(HIST, np.int64), []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            text = text or ""
            hist += np.bincount(np.minimum(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), HIST), minlength=HIST + 1)[:HIST]
            base, found = base_spans(text), []
            reach = _reach(base)
            for m in RUN.finditer(text):
                for left, right in _between(*m.span(), base, reach):
                    for s, e, run in candidates(text, left, right):
                        name = encoding_of(run)
                        if name:
                            symbols = SYMBOL[name][np.frombuffer(run.encode("ascii"), np.uint8)]
                            found.append((s, e, len(run), name, *battery(symbols, len(ALPHABETS[name]))))
            rows.append((doc_id, [f"{KINDS[k]}:{s}:{e}" for s, k, e in base], [s for s, _, _ in base], found, None))
        rows.append((None, None, None, None, hist.tolist()))
        yield pd.DataFrame(rows, columns=["doc_id", "base", "starts", "runs", "hist"])


SCHEMA = ("doc_id string, base array<string>, starts array<int>, hist array<bigint>, "
          "runs array<struct<start:int,stop:int,length:int,encoding:string,chi:double,runs_p:double,serial_p:double>>")


def _chance(n: int, chi: float, share: np.ndarray) -> float:
    """Chance that ordinary text of length n has a uniformity statistic as low as ``chi``; ``share`` sums to 1."""
    k = len(share)
    s2, s3 = float((share ** 2).sum()), float((share ** 3).sum())
    mean = k * (1 - s2) + k * n * s2 - n
    var = 4 * n * k * k * max(s3 - s2 * s2, 0.0) + 2 * k * k * max(s2 - 2 * s3 + s2 * s2, 1e-12)
    return 0.5 * math.erfc((mean - chi) / math.sqrt(2 * var))


def scan(docs: DataFrame, false_rate: float = 0.01, reject: float = 0.001) -> DataFrame:
    """doc_id and spans (array of kind:start:end, base and found, in order) of every document, with base apart.

    ``false_rate``: share of wrong reports accepted among the reports of one encoding and
    length band; ``reject``: a run is not random if a test's p-value is below it.
    """
    kind = docs.schema["doc_id"].dataType
    columns = [x.split()[0] for x in SCHEMA.split(", ")]
    seen = materialize(docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(
        lambda it: (b[columns] for b in _scan(it)), SCHEMA), "scanned")
    sums = seen.where(F.col("hist").isNotNull()).select(F.posexplode("hist").alias("code", "n")).groupBy("code").agg(F.sum("n").alias("n")).collect()
    ordinary = np.zeros(HIST)
    for r in sums:  # 128 rows at most
        ordinary[r["code"]] = r["n"]
    shares = {}
    for name, chars in ALPHABETS.items():
        own = ordinary[[ord(c) for c in chars]] + 0.5
        shares[name] = own / own.sum()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Adds to every run its band and score: -100 * log10 of its p-value, or -1 if a test rejects randomness."""
        for batch in batches:
            out = []
            for runs in batch["runs"]:
                row = []
                for r in runs:
                    k, n = len(ALPHABETS[r["encoding"]]), r["length"]
                    ps = (_chi_tail(r["chi"], k - 1), r["runs_p"], r["serial_p"])
                    p = _chance(n, r["chi"], shares[r["encoding"]])
                    score = int(-100 * math.log10(max(p, 1e-300))) if min(ps) >= reject else -1
                    row.append((r["start"], r["stop"], f"{r['encoding']}-{n.bit_length()}", score))
                out.append(row)
            yield batch[["doc_id", "base", "starts"]].assign(runs=out)

    judged = materialize(seen.where(F.col("hist").isNull()).mapInPandas(
        judge, "doc_id string, base array<string>, starts array<int>, runs array<struct<start:int,stop:int,band:string,score:int>>"), "judged")
    counts = (judged.select(F.explode("runs").alias("r")).groupBy("r.band", "r.score").agg(F.count("*").alias("n")).collect())
    least = _least_scores([(r["band"], r["score"], r["n"]) for r in counts], false_rate)

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for base, starts, runs in zip(batch["base"], batch["starts"], batch["runs"]):
                hits = _apart([(r["score"], r["start"], r["stop"]) for r in runs if r["score"] >= least.get(r["band"], math.inf)])
                rows = sorted([(int(a), 0, b) for a, b in zip(starts, base)] + [(a, 1, f"random:{a}:{b}") for a, b in hits])
                out.append([x[2] for x in rows])
            yield batch[["doc_id", "base"]].assign(spans=out)

    reported = judged.mapInPandas(report, "doc_id string, base array<string>, spans array<string>")
    return reported.select(F.col("doc_id").cast(kind), "base", "spans")


def _apart(hits: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Of (score, start, end) the spans with the highest scores that do not overlap, the longer one at equal scores."""
    kept: list[tuple[int, int]] = []
    for _, s, e in sorted(hits, key=lambda x: (-x[0], x[1] - x[2], x[1])):
        at = bisect.bisect_left(kept, (s, e))
        if (at == 0 or kept[at - 1][1] <= s) and (at == len(kept) or kept[at][0] >= e):
            kept.insert(at, (s, e))
    return kept


def _least_scores(counts: list[tuple[str, int, int]], false_rate: float) -> dict[str, int]:
    """Benjamini-Hochberg per band: the least score reported. Scores are rounded down, so p-values are never understated."""
    out = {}
    for band in {c[0] for c in counts}:
        rows = sorted(((s, n) for b, s, n in counts if b == band), reverse=True)
        total, reached = sum(n for _, n in rows), 0
        for score, n in rows:
            reached += n
            if score >= 0 and 10 ** (-score / 100) * total <= false_rate * reached:
                out[band] = score
    return out


def digest(scanned: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans and all spans as text."""
    def count(kind: str):
        return F.size(F.filter("base", lambda b: b.startswith(kind + ":"))).cast("long").alias("n_" + kind)

    return scanned.select("doc_id", count("assign"), count("access"), count("hex"),
                          F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))


def mask(docs: DataFrame, mark: str = "<secret>", **options) -> DataFrame:
    """The documents with every found span replaced by ``mark``; all columns stay, n_chars follows the text.

    The spans are found again from the text's own scan, joined by id and text, so equal ids cannot mix.
    """
    key = F.struct(F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("md5")).cast("string")
    found = scan(docs.select(key.alias("doc_id"), "text"), **options).where(F.size("spans") > 0)
    found = found.select(F.col("doc_id").alias("key"), "spans").dropDuplicates(["key"])
    rows = whole(docs, key=key, text=F.col("text")).join(found, "key", "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, s, mark) for t, s in zip(texts, spans)])

    clean = rows.where(F.col("spans").isNull()).select("whole.*")
    masked = rows.where(F.col("spans").isNotNull()).withColumn("masked", cut("text", "spans"))
    return clean.unionByName(replaced(masked, docs, F.col("masked")))


def _cut(text: str, spans: list[str], mark: str) -> str:
    parts, at = [], 0
    for start, end in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in spans):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join(parts) + text[at:]
