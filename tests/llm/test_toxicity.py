import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa

from textloom.llm import toxicity as X

from .cases import documents, empty


def brute(scores):
    """Maximal segments by their definition: recursively the best segment, then left and right of it."""
    best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i = -best[2]
    j = i - best[1]
    return brute(scores[:i]) + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in brute(scores[j:])]


def test_segments_are_the_maximal_ones():
    rng = random.Random(1)
    for _ in range(200):
        scores = [rng.choice([-3, -2, -1, 1, 2, 3]) + rng.random() * 1e-3 for _ in range(rng.randint(0, 12))]
        got = X.maximal_segments(scores)
        want = brute(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def corpus(spark):
    rng = random.Random(5)
    plain = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(1200):
        words = [rng.choice(plain) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            at = rng.randrange(50)
            words[at : at + 4] = [rng.choice(["vile", "scummy", "rotten"]) for _ in range(4)]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_planted_passages_are_found_and_clean_texts_left(spark):
    docs, labels = corpus(spark)
    model = X.fit(docs, labels)
    got = X.score(docs, model).collect()
    wrong = [r.doc_id for r in got if r.toxic != (r.doc_id % 4 == 0)]
    assert len(wrong) <= 2
    assert X.keep(docs, model).count() == sum(not r.toxic for r in got)
    segment = next(r for r in got if r.doc_id == 0).segments[0]
    assert segment.end - segment.start >= 3


def test_hostile_rows(spark):
    docs, labels = corpus(spark)
    model = X.fit(docs, labels.unionByName(spark.createDataFrame([(None, None, None), (3, 1, None), (99999, 1, 1)], labels.schema)))
    own = documents(spark)
    got = X.score(own, model).collect()
    assert len(got) == own.count() and not any(r.toxic for r in got)
    assert all(r.evalue == 1 and not r.segments for r in got if r.tokens == 0)
    assert X.keep(own, model).columns == own.columns
    assert X.score(empty(spark), model).count() == 0


def test_without_labels_nothing_is_toxic(spark):
    docs, labels = corpus(spark)
    for few in (labels.where("toxic = 0"), labels.limit(0)):
        model = X.fit(docs, few)
        assert not len(model.words)
        assert X.score(docs, model).where("toxic").count() == 0
    assert not len(X.fit(empty(spark), labels).words)


def test_log_odds_are_those_of_a_plain_loop(spark):
    docs, labels = corpus(spark)
    model = X.fit(docs, labels)
    held = {r.doc_id for r in docs.where("pmod(xxhash64(doc_id), 4) = 0").collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    bags = {r.doc_id: set(r.text.split()) for r in docs.collect()}
    n = [sum(len(b) for i, b in bags.items() if i not in held and toxic[i] == c) for c in (0, 1)]
    in_class = lambda w, c: sum(w in b for i, b in bags.items() if i not in held and toxic[i] == c)
    everywhere = sum(len(b) for b in bags.values())
    strength = 0.1 * sum(n)
    want = {}
    for w in sorted({w for b in bags.values() for w in b}):
        a = sum(w in b for b in bags.values()) / everywhere * strength
        t, c = in_class(w, 1) + a, in_class(w, 0) + a
        odds = math.log(t / (n[1] + strength - t)) - math.log(c / (n[0] + strength - c))
        if in_class(w, 1) and odds / math.sqrt(1 / t + 1 / c) > 3.3 and odds > 2:
            want[w] = odds
    share = sum(in_class(w, 1) for w in want) / n[1]
    shift = math.log(0.25 / share) if share < 0.25 else 0
    hashes, _ = X.tokens(pa.array(list(want)))
    got = dict(zip(model.words.tolist(), model.scores.tolist(), strict=True))
    assert set(got) == set(hashes.tolist()) and set(want) == {"vile", "scummy", "rotten"}
    assert all(abs(got[h] - want[w] - shift) < 1e-9 for h, w in zip(hashes.tolist(), want))


def test_clean_texts_pass_an_evalue_as_often_as_it_says():
    """On clean texts, where bad words come alone or, which the law doesn't know, in bursts."""
    words, _ = X.tokens(pa.array(["bad", "worse", "worst"]))
    order = np.argsort(words)
    rng = random.Random(4)

    def texts(n, burst):
        out = []
        for _ in range(n):
            t = [f"w{rng.randrange(300)}" for _ in range(150)]
            for _ in range(2):
                if rng.random() < 0.15:
                    at = rng.randrange(140)
                    for i in range(rng.choice([1, burst])):
                        t[at + i] = rng.choice(["bad", "worse", "worst"])
            out.append(" ".join(t))
        return pa.array(out)

    for burst in (1, 3):
        model = X.Model(words[order], np.array([2.0, 2.5, 3.0])[order], math.log(0.75), 1.0, 1.0)
        h, counts = X.tokens(texts(3000, burst))
        at, found = X._hits(model, h, counts)
        tally = lambda x: pd.DataFrame(dict(zip(("score", "n"), np.unique(np.round(x, 2), return_counts=True))))
        model = X.settle(model, tally(model.scores[at]), tally([s for _, own in found for *_, s in own]), float(len(h)))
        for level in (0.01, 0.05):
            evalue = X.judge(model, texts(3000, burst), level)[1]
            assert (evalue <= level).mean() <= 1.5 * level + 0.002
        assert X.judge(model, pa.array(["w1 w2 " + "bad worse worst worse " * 5 + "w3 w4"]), 0.01)[0][0]
