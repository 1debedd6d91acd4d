"""Language identification by mixture inference over character n-grams.

Model: for every language a distribution over hashed character n-grams (one to three
code points, lower case, letters and single blanks), fitted on a bounded sample of the
labelled rows. Inference: a document's n-grams come from a mixture of languages;
expectation-maximisation estimates the proportions, and languages are dropped one by
one while the penalised likelihood improves. The language with the largest proportion
is the answer, its proportion the score.

The model is languages x ``BUCKETS`` numbers on every worker, so the label column may hold at most
``MOST_LANGUAGES`` values; more are an error, not a cut.

Defined cases: a null text or one without a letter (Unicode category L; digits, superscripts,
fractions and circled numbers are none) is ``und`` with score 0; a very long text is counted
whole, in memory of its own size; without any labelled row everything is ``und``; ties go to the smaller language value; repeated rows
are predicted alike; other columns are not looked at.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F


BUCKETS = 1 << 15
LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")  # marks belong to the letters of Indic and vocalised scripts
MOST_LANGUAGES = 1000


def ngrams(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a whole text: distinct buckets and how often each occurs."""
    clean = f" {NOT_LETTERS.sub(' ', text.lower()).strip()} "
    code = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    one, two = code, (code[:-1] << np.uint64(21)) | code[1:]
    three = (two[:-1] << np.uint64(21)) | code[2:]
    counts = np.zeros(buckets, np.int64)
    for n, grams in enumerate((one, two, three)):
        hashed = (grams * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n + 1)) * np.uint64(0xBF58476D1CE4E5B9)
        counts += np.bincount((hashed >> np.uint64(49)).astype(np.int64), minlength=buckets)
    found = np.flatnonzero(counts)
    return found, counts[found].astype(float)


class Model:
    """Languages and the probability of every bucket in each of them."""

    def __init__(self, languages: list[str], probability: np.ndarray):
        self.languages, self.probability = languages, np.ascontiguousarray(probability.T)  # bucket x language
        self.log = np.log(self.probability)

    def _fit(self, p: np.ndarray, counts: np.ndarray, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        total = counts.sum()
        for _ in range(rounds):
            new = shares * ((counts / (p @ shares)) @ p) / total
            still = np.abs(new - shares).max() < 1e-3
            shares = new
            if still:
                break
        return shares, float(counts @ np.log(p @ shares))

    def infer(self, text: str, penalty: float = 12.0, rounds: int = 30) -> np.ndarray:
        """Proportion of every language in a text; languages that do not pay their penalty get 0.

        A language costs ``penalty`` half-logs of the text's n-gram count (overlapping
        n-grams repeat the same evidence, hence more than one).
        """
        buckets, counts = ngrams(text)
        p, n = self.probability[buckets], counts.sum()
        cost = penalty * 0.5 * np.log(n)
        alone = counts @ self.log[buckets]
        active = np.arange(len(self.languages))
        shares, fit = self._fit(p, counts, np.full(len(active), 1.0 / len(active)), rounds)
        keep = shares > 0.005
        while True:
            if not keep.all():
                active, shares = active[keep], shares[keep] / shares[keep].sum()
                if len(active) == 1:
                    fit, shares = float(alone[active[0]]), np.ones(1)
                else:
                    shares, fit = self._fit(p[:, active], counts, shares, rounds)
            if len(active) == 1:
                break
            keep = np.ones(len(active), bool)
            keep[len(active) - 1 - int(np.argmin(shares[::-1]))] = False
            rest = active[keep]
            if len(rest) == 1:
                less = float(alone[rest[0]])
            else:
                _, less = self._fit(p[:, rest], counts, shares[keep] / shares[keep].sum(), rounds)
            if less + cost < fit:
                break
        out = np.zeros(len(self.languages))
        out[active] = shares
        best = int(np.argmax(alone))
        if len(active) == 1 and alone[best] > alone[active[0]]:
            out[:] = 0.0
            out[best] = 1.0
        return out


def fit(labelled: DataFrame, rows_each: int = 2000, seed: int = 5) -> Model | None:
    """Model from labelled rows (text, lang). Sample: about ``rows_each`` different texts of each language, by a seeded hash, or all if it has fewer; a text counts once, however many copies there are."""
    code = F.xxhash64("text", F.lit(seed))
    sizes = labelled.groupBy("lang").agg(F.countDistinct(code).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if not sizes:
        return None
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages among the labels")
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], rows_each / r["n"])])
    part = F.pmod(code, F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.where(part < share[F.col("lang")]).select("lang", "text").distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                sums = np.zeros(BUCKETS)
                for text in texts:
                    if LETTER.search(text):
                        at, n = ngrams(text)
                        sums[at] += n / n.sum() * 1000.0  # every text weighs the same
                found = np.flatnonzero(sums)
                yield pd.DataFrame({"lang": lang, "bucket": found, "n": sums[found]})

    table = (chosen.mapInPandas(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    if table.empty:
        return None
    languages = sorted(table["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[np.searchsorted(languages, table["lang"]), table["bucket"]] = np.round(table["n"], 6)
    smooth = counts + 0.5
    return Model(languages, smooth / smooth.sum(1, keepdims=True))


def predict(docs: DataFrame, model: Model | None, *carry: str) -> DataFrame:
    """lang_pred, score and mixture (language to proportion) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 32,768 numbers

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        for batch in batches:
            rows = []
            for text in batch["text"]:
                if fitted is None or text is None or not LETTER.search(text):
                    rows.append(("und", 0.0, {}))
                    continue
                shares = fitted.infer(text)
                best = int(np.argmax(shares))
                mixture = {fitted.languages[i]: float(shares[i]) for i in np.flatnonzero(shares)}
                rows.append((fitted.languages[best], min(1.0, float(shares[best])), mixture))
            yield pd.concat([batch[list(carry)].reset_index(drop=True), pd.DataFrame(rows, columns=["lang_pred", "score", "mixture"])], axis=1)

    kinds = {c: docs.schema[c].dataType for c in carry}
    schema = ", ".join([f"`{c}` string" for c in carry] + ["lang_pred string", "score double", "mixture map<string,double>"])
    out = docs.select(*[F.col(c).cast("string") for c in carry], "text").mapInPandas(guess, schema)
    return out.select(*[F.col(c).cast(kinds[c]) for c in carry], "lang_pred", "score", "mixture")


def identify(docs: DataFrame, rows_each: int = 2000) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Rows whose crc32 of the id leaves remainder 2 by 4 are held out of the fit."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang"), rows_each)
    return predict(docs, model, "doc_id").select("doc_id", held.alias("held_out"), "lang_pred", "score")
