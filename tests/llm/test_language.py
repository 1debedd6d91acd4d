import itertools
import random
import zlib

import numpy as np
import pytest

from palaver.llm import language

from .helpers import ODD, docs

SYLLABLES = {"aa": "tha er on ing ou st re nd", "bb": "ich ung ver sch ein keit ge", "cc": "que é eau oi ment les ai", "dd": "ción os ado ñ mente ll ar"}


def text(lang, n, seed):
    rng = random.Random(seed)
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def table(spark):
    rows = [(i, text(list(SYLLABLES)[i % 4], 40 + i % 60, i), list(SYLLABLES)[i % 4], "s") for i in range(200)]
    return docs(spark, rows + rows[:2] + ODD + [(3000, "12345 !!", "en", "s"), (3001, text("aa", 60, 1) + " " + text("bb", 200, 2), None, "s")])


def test_held_out_accuracy_and_undetermined(spark):
    df = table(spark)
    got = language.identify(df).collect()
    assert len(got) == df.count()
    truth = {r.doc_id: r.lang for r in df.collect()}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 200]
    assert held and all(r.lang_pred == truth[r.doc_id] for r in held)
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    by = {r.doc_id: r for r in got}
    assert {by[i].lang_pred for i in (901, 902, 903, 3000)} == {"und"} and by[3001].lang_pred == "bb"


def test_mixture_of_two_languages(spark):
    df = table(spark)
    model = language.fit(df.where("lang in ('aa', 'bb', 'cc', 'dd') and text is not null").select("text", "lang"))
    shares = dict(zip(model.languages, model.infer(text("aa", 150, 9) + " " + text("cc", 150, 8))))
    assert min(shares["aa"], shares["cc"]) > 0.25 and shares["bb"] == shares["dd"] == 0
    assert list(model.infer(text("dd", 80, 5))) == [0, 0, 0, 1]


def test_no_labels(spark):
    got = language.identify(docs(spark, [(1, "text", None, "s")])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert language.identify(docs(spark, [])).count() == 0


def test_copies_neither_hide_a_language_nor_fill_the_sample(spark):
    rows = [(10 * i + k, text(lang, 50, i), lang, "s") for lang, first in (("aa", 0), ("bb", 100), ("cc", 200)) for i in range(first, first + 3) for k in range(60)]
    df = docs(spark, [(i + 10000 * n, t, lang, s) for n, (i, t, lang, s) in enumerate(rows)])
    model = language.fit(df.select("text", "lang"), rows_each=5)
    assert model.languages == ["aa", "bb", "cc"]


def exhaustive(model, words, penalty=12.0):
    """Best set of languages of all sets by penalised likelihood, each fitted by plain EM."""
    buckets, counts = language.ngrams(words)
    p, n = model.probability[buckets], counts.sum()
    best = None
    for size in range(1, len(model.languages) + 1):
        for chosen in itertools.combinations(range(len(model.languages)), size):
            shares = np.full(size, 1 / size)
            for _ in range(300):
                joint = p[:, chosen] * shares
                shares = (counts[:, None] * joint / joint.sum(1, keepdims=True)).sum(0) / n
            value = counts @ np.log(p[:, chosen] @ shares) - size * penalty * 0.5 * np.log(n)
            if best is None or value > best[0]:
                best = value, dict(zip(chosen, shares))
    return best[1]


def test_inference_equals_exhaustive_choice_of_languages(spark):
    df = table(spark)
    model = language.fit(df.where("lang in ('aa', 'bb', 'cc', 'dd') and text is not null").select("text", "lang"))
    mixes = [{"aa": 60}, {"dd": 5}, {"aa": 100, "cc": 100}, {"bb": 200, "dd": 60}, {"aa": 90, "bb": 90, "cc": 90}, {"aa": 80, "bb": 80, "cc": 80, "dd": 80}]
    for seed, mix in enumerate(mixes):
        words = " ".join(text(lang, n, 70 + seed) for lang, n in mix.items())
        shares, want = model.infer(words), exhaustive(model, words)
        assert set(np.flatnonzero(shares)) == set(want), mix
        assert all(abs(shares[i] - share) < 0.02 for i, share in want.items())


def test_letters_are_category_l_and_marks_stay_in_words(spark):
    rows = [(1, "\u00b2 \u00bd \u2460 \u2167 12 _", None, "s"), (2, "\u00b2 ich", None, "s"), (3, "ich ver", "bb", "s"), (4, "ung ein", "bb", "s"), (5, "the on", "aa", "s"), (6, "ing ou", "aa", "s"), (7, "\u0301\u0902", None, "s")]
    got = {r.doc_id: r.lang_pred for r in language.identify(docs(spark, rows)).collect()}
    assert got[1] == got[7] == "und" and got[2] != "und"
    word = "\u0939\u093f\u0928\u094d\u0926\u0940"
    assert language.NOT_LETTERS.sub(" ", word) == word


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    with pytest.raises(ValueError):
        language.fit(table(spark).select("text", "lang").where("lang is not null and text is not null"))
