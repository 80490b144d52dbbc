import inspect
import itertools
import random

import numpy as np
import pyarrow as pa
from textloom.llm import langid as X

from .cases import documents, empty

WORDS = {"en": "the of and house river think something with from walking".split(), "de": "der und nicht haus fluss denken etwas mit von gehen straße".split(), "fr": "le et ne maison rivière penser quelque avec depuis marcher être".split()}


def texts(n, seed):
    rng = random.Random(seed)
    return [(lang, " ".join(rng.choice(words) for _ in range(30))) for lang, words in WORDS.items() for _ in range(n)]


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(0)
    emit, transitions, first = rng.random((5, 3)) + 0.1, rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    word, counts = np.array([0, 3, 1, 4, 2, 2, 0]), np.array([0, 4, 4, 7])
    got = X.marginals(emit.astype(np.float32), word, counts, transitions, first)
    for a, b in ((0, 4), (4, 7)):
        want = np.zeros((b - a, 3))
        for y in itertools.product(range(3), repeat=b - a):
            p = first[y[0]] * np.prod([emit[word[a + i], y[i]] for i in range(b - a)]) * np.prod([transitions[y[i], y[i + 1]] for i in range(b - a - 1)])
            for i, k in enumerate(y):
                want[i, k] += p
        assert np.allclose(got[a:b], want / want.sum(1, keepdims=True), atol=1e-5)


def test_held_out_accuracy_and_switches(spark):
    model = X.train(texts(40, 1), sequences=400)
    docs = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(texts(20, 2))], "doc_id long, lang string, text string")
    got = X.score(docs, model).join(docs, "doc_id").collect()
    assert sum(r.language == r.lang for r in got) >= 0.95 * len(got)
    mixed = spark.createDataFrame([(1, " ".join(WORDS["en"] * 2 + WORDS["de"] * 2))], "doc_id long, text string")
    (row,) = X.score(mixed, model).collect()
    assert [s.language for s in row.segments] == ["en", "de"]
    assert abs(row.segments[0].end - 20) <= 1 and row.segments[-1].end == row.words


def test_noise_is_und(spark):
    model = X.train(texts(40, 1), sequences=400)
    rng = random.Random(3)
    noise = " ".join("".join(rng.choice("qxzjkwvpy") for _ in range(8)) for _ in range(60))
    (row,) = X.score(spark.createDataFrame([(1, noise)], "doc_id long, text string"), model).collect()
    assert row.language == "und" and not row.accepted


def test_hostile_rows(spark):
    docs = documents(spark)
    model = X.fit(docs)
    got = X.score(docs, model).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.words == 0:
            assert r.language is None and not r.accepted and r.segments == []
        else:
            assert sum(s.end - s.start for s in r.segments) == r.words
    kept = X.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.accepted for r in got)
    assert X.score(empty(spark), model).count() == 0


def test_without_languages_nothing_is_accepted(spark):
    assert X.fit(empty(spark)) is None
    assert X.score(documents(spark), None).where("accepted").count() == 0
    assert X.keep(documents(spark), None).count() == 0


def test_more_languages_than_bits(spark, monkeypatch):
    rows = [(i, f"l{i % 70:02}", f"word{i % 70}a word{i % 70}b other") for i in range(210)]
    model = X.train([(lang, t) for _, lang, t in rows], rounds=2, sequences=50)
    assert model.labels == [*sorted({lang for _, lang, _ in rows}), "und"]
    assert model.members.sum(0).tolist() == [3] * 70
    monkeypatch.setattr(X, "train", lambda found: found)
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert {lang for lang, _ in X.fit(docs)} == {lang for _, lang, _ in rows}


def test_mostly_unknown_words_are_rejected():
    model = X.train(texts(40, 1), sequences=400)
    rng = random.Random(5)
    noise = ["".join(rng.choice("qxzjkwvpy") for _ in range(8)) for _ in range(70)]
    for words in (30, 100):
        text = " ".join([rng.choice(WORDS["en"]) for _ in range(words)] + noise[: 70 if words == 30 else 30])
        g, *_ = X.decide(model, pa.array([text]), 0.5)
        known = float(g[:, :-1].sum(1).mean())
        assert abs(known - words / (words + (70 if words == 30 else 30))) < 0.15
        accepted = X.decide(model, pa.array([text]), inspect.signature(X.keep).parameters["least_known"].default)[4]
        assert bool(accepted[0]) == (words == 100)


def test_ties_take_the_first_label():
    model = X.train(texts(20, 1), rounds=2, sequences=50)
    model.weights[:] = 0
    model.lex[:] = 0
    model.transitions[:], model.first[:] = 1, 1
    _, _, top, share, accepted = X.decide(model, pa.array(["alpha beta gamma"]), 0.5)
    assert model.labels[top[0]] == "de" and accepted[0] and abs(share[0] - 1 / len(model.labels)) < 1e-6


def test_words_that_touch_symbols_are_in_no_language():
    model = X.train(texts(40, 1), sequences=400)
    words = WORDS["en"] * 4
    plain, junk, some = " ".join(words), " ".join(w + "###" for w in words), " ".join(w + "%%%" * (i % 4 == 0) for i, w in enumerate(words))
    assert X.symbol_runs(pa.array([plain, junk, some, None, "#", "##", "a##", "##b"])).tolist() == [0, len(words), len(words) // 4, 0, 0, 1, 1, 1]
    assert X.decide(model, pa.array([plain, junk, some]), 0.5)[4].tolist() == [True, False, True]
