import random

import numpy as np
from textloom.llm import suffix as X

from .cases import PROSE, documents, empty


def test_two_stage_order_and_common_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(150):
        t = rng.integers(0, rng.integers(1, 6), rng.integers(1, 50))
        sa = X.suffix_array(t, 60).tolist()
        assert sa == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        lcp = X.common_prefixes(t, np.array(sa), 20)
        for a, b, n in zip(sa, sa[1:], lcp[1:]):
            k = 0
            while k < 20 and max(a, b) + k < len(t) and t[a + k] == t[b + k]:
                k += 1
            assert k == n


def brute(rows, window):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words, covered = text.split(), set()
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            if key in seen:
                covered.update(range(p, p + window))
            seen.add(key)
        if covered:
            out[i] = covered
    return out


def covered(found):
    out = {}
    for r in found:
        assert not out.setdefault(r.doc_id, set()) & set(range(r.start, r.end))
        out[r.doc_id] |= set(range(r.start, r.end))
    return out


def test_duplicates_are_those_of_brute_force(spark):
    rng = random.Random(3)
    shared = [[f"s{k}w{rng.randrange(50)}" for _ in range(rng.randint(15, 60))] for k in range(6)]
    rows = []
    for i in range(80):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            at, s = rng.randint(0, len(words)), rng.choice(shared)
            lo = rng.randrange(len(s) // 2)
            words[at:at] = s[lo : rng.randint(lo + 1, len(s))]
        if i % 9 == 0:
            words += ["again", "and"] * rng.randint(5, 30)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert covered(X.repeats(docs, window=10, k=4).collect()) == brute(rows, 10)
    assert covered(X.repeats(docs, window=10, k=4, heavy=3).collect()) == brute(rows, 10)  # hot minimisers, window by window
    cut = {r.doc_id: r.text.split() for r in X.cut(docs, window=10, k=4).collect()}
    gone = brute(rows, 10)
    assert cut == {i: [w for p, w in enumerate(t.split()) if p not in gone.get(i, ())] for i, t in rows}


def test_hostile_rows(spark):
    docs = documents(spark)
    got = covered(X.repeats(docs, window=10, k=4).collect())
    n = len(PROSE.split())
    assert 1 not in got and got[2] == set(range(n))  # the least id stays whole
    assert got[None] == set(range(n))  # a null id comes last; its own word stays
    assert got[12] == set(range(1, 300))  # the first period stays
    assert set(got) <= {2, 3, 9, 12, None}
    cut = X.cut(docs, window=10, k=4)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    by = {}
    for r in cut.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert [r.text for r in by[2]] == ["", ""] and [r.n_chars for r in by[2]] == [0, 0]
    assert by[1][0].text == PROSE and by[4][0].text is None and by[6][0].text == " \n\t "
    assert by[None][0].text == "again"
    assert X.repeats(empty(spark)).count() == 0 and X.cut(empty(spark)).count() == 0
