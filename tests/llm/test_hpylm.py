import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from textloom.llm import hpylm as X

from .cases import documents, empty


def tokens():
    rng = random.Random(1)
    u = np.array([rng.choice([11, 12, 13]) for _ in range(160)], np.uint64)
    w = np.array([rng.choice([21, 21, 21, 22, 22, 23, 24, 25 + rng.randrange(20)]) for _ in range(160)], np.uint64)
    return u, w


def bucket():
    b = X.Bucket.__new__(X.Bucket)
    b.seat(*tokens())
    return b


def exact(b, parent, strength, sweeps, burn, seed):
    """Sequential Gibbs, one customer at a time, tables as lists of sizes."""
    rng, d = random.Random(seed), b.discount
    tables = [[int(c)] for c in b.c]
    total = {k: sum(len(tables[i]) for i in range(len(b.c)) if b.context[i] == k) for k in set(b.context.tolist())}
    customers = {k: int(b.c[b.context == k].sum()) for k in total}
    mass = np.zeros(len(b.c))
    for sweep in range(sweeps):
        for i in range(len(b.c)):
            k, p = b.context[i], parent[b.dish[i]]
            for _ in range(int(b.c[i])):
                at = rng.choices(range(len(tables[i])), tables[i])[0]
                tables[i][at] -= 1
                if not tables[i][at]:
                    del tables[i][at]
                    total[k] -= 1
                weights = [x - d for x in tables[i]] + [(strength + d * total[k]) * p]
                if sweep >= burn:
                    mass[i] += sum(weights) / (strength + customers[k] - 1)
                at = rng.choices(range(len(weights)), weights)[0]
                if at == len(tables[i]):
                    tables[i].append(1)
                    total[k] += 1
                else:
                    tables[i][at] += 1
    return mass / b.c / (sweeps - burn), np.array([len(t) for t in tables])


def test_averaged_probabilities_are_those_of_sequential_gibbs():
    b = bucket()
    parent = np.full(len(b.words), 1 / 30)
    _, customers, tables = b.counts()
    want, _ = exact(b, parent, 1.0, 600, 100, 1)
    got = b.gibbs(parent, customers, tables, 1.0, 600, 100, np.random.Generator(np.random.PCG64(0)))
    assert np.max(np.abs(got - want) / want) < 0.06
    assert abs(float((np.log(got) * b.c).sum() / b.c.sum()) - float((np.log(want) * b.c).sum() / b.c.sum())) < 0.01


def test_seating_stays_consistent():
    b = bucket()
    _, customers, tables = b.counts()
    for _ in range(5):
        b.gibbs(np.full(len(b.words), 0.03), customers, b.counts()[2], 1.0, 3, 1, np.random.Generator(np.random.PCG64(3)))
        assert (b.t >= 1).all() and (b.t <= b.c).all()


def test_words_survive_packing():
    x = np.array([0, 1, 2**40 - 1, 12345678901], np.uint64)
    assert X.unpack_words(X.pack_words(x)).tolist() == x.tolist()


def test_perplexity_tells_fluent_from_shuffled(spark):
    rng = random.Random(2)
    chain = {i: [rng.randrange(50) for _ in range(2)] for i in range(50)}
    rows = []
    for i in range(200):
        at, words = rng.randrange(50), []
        for _ in range(60):
            words.append(f"w{at}")
            at = rng.choice(chain[at])
        if i % 20 == 0:
            rng.shuffle(words)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (X.BUCKET_BYTES, 8_000):  # one bucket, or several
        got = {r.doc_id: r for r in X.perplexity(docs, bucket_bytes=size).collect()}
        fluent = sorted(r.perplexity for i, r in got.items() if i % 20)
        shuffled = sorted(r.perplexity for i, r in got.items() if i % 20 == 0)
        assert len(got) == 200 and all(r.tokens == 60 for r in got.values())
        assert fluent[len(fluent) // 2] * 2 < shuffled[len(shuffled) // 2]
        assert fluent[len(fluent) // 2] < 6


def test_hostile_rows(spark):
    docs = documents(spark)
    got = X.perplexity(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.perplexity is None) == (r.tokens == 0)
        assert r.tokens == 0 or (math.isfinite(r.perplexity) and r.perplexity > 0)
    assert sum(r.doc_id is None for r in got) == 1 and sum(r.doc_id == 2 for r in got) == 2
    assert X.perplexity(empty(spark)).count() == 0


def test_a_word_seen_once_is_predicted_by_the_base_alone():
    parts, base_size = 1, 1000.0
    b = X.Bucket.__new__(X.Bucket)
    b.seat(np.array([11, 11, 11, 12, 12], np.uint64), np.array([21, 21, 22, 21, 23], np.uint64))
    back = X._parent(parts, base_size, 1.0, 4, 0)(X._stats(b, 0, parts))
    p, customers, tables, lone = X._from_parent(b, back, base_size, 1.0)
    once = int(np.searchsorted(b.words, 23))
    # 4 tables in the parent before, 3 after; those of 22 and 23 are the parent's only ones.
    d, t = float(np.frombuffer(back.column("data")[0].as_py(), np.float32, 1)[0]), int(back.column("tables")[0].as_py())
    assert math.isclose(lone[once], (1 + d * (t - 1)) / base_size / (1 + 4 - 1), rel_tol=1e-6)
    got = b.gibbs(p, customers, tables, 1.0, 4, 2, np.random.Generator(np.random.PCG64(0)), lone)
    i = int(np.flatnonzero(b.dish == once)[0])
    rest = np.bincount(b.context, b.t)[b.context[i]] - 1
    assert math.isclose(got[i], (1 + b.discount * rest) * lone[once] / (1 + 2 - 1), rel_tol=1e-6)


def test_a_bucket_goes_on_from_its_seating():
    b, seen = bucket(), []
    for i in range(30):
        back = X._parent(1, 1000.0, 1.0, 4, i)(X._stats(b, 0, 1))
        p, customers, tables, lone = X._from_parent(b, back, 1000.0, 1.0)
        assert np.array_equal(tables, b.counts()[2])  # one bucket: nothing is elsewhere
        before = b.seating.copy(), b.t.copy()
        c = bucket()
        c.go_on(before[0])
        assert np.array_equal(c.t, before[1])
        b.gibbs(p, customers, tables, 1.0, 1, 1, np.random.Generator(np.random.PCG64(i)), lone)
        seen.append(int(b.t.sum()))
    assert seen[-1] > len(b.c) and len(set(seen)) > 5


def discount(counts):
    n1, n2 = counts.count(1), counts.count(2)
    return min(0.95, max(0.05, n1 / max(1, n1 + 2 * n2)))


def hierarchy(b, base, strength, sweeps, burn, seed):
    """Sequential Gibbs over contexts and parent at once: a table that opens or closes is a customer of the parent that comes or goes."""
    rng, d = random.Random(seed), b.discount
    tables = [[int(c)] for c in b.c]
    above = {}  # dish: sizes of the parent's tables
    for i in range(len(b.c)):
        above.setdefault(int(b.dish[i]), [0])[0] += 1
    total = {k: sum(b.context == k) for k in set(b.context.tolist())}
    customers = {k: int(b.c[b.context == k].sum()) for k in total}
    mass = np.zeros(len(b.c))

    def p(w, d0):
        own = above.get(w, [])
        return (sum(x - d0 for x in own) + (strength + d0 * sum(map(len, above.values()))) / base) / (strength + sum(map(sum, above.values())))

    for sweep in range(sweeps):
        d0 = discount([sum(x) for x in above.values()])
        for i in range(len(b.c)):
            k, w = int(b.context[i]), int(b.dish[i])
            for _ in range(int(b.c[i])):
                at = rng.choices(range(len(tables[i])), tables[i])[0]
                tables[i][at] -= 1
                if not tables[i][at]:
                    del tables[i][at]
                    total[k] -= 1
                    up = above[w]
                    j = rng.choices(range(len(up)), up)[0]
                    up[j] -= 1
                    if not up[j]:
                        del up[j]
                    if not up:
                        del above[w]
                weights = [x - d for x in tables[i]] + [(strength + d * total[k]) * p(w, d0)]
                if sweep >= burn:
                    mass[i] += sum(weights) / (strength + customers[k] - 1)
                at = rng.choices(range(len(weights)), weights)[0]
                if at < len(tables[i]):
                    tables[i][at] += 1
                    continue
                tables[i].append(1)
                total[k] += 1
                up = above.setdefault(w, [])
                choice = [x - d0 for x in up] + [(strength + d0 * sum(map(len, above.values()))) / base]
                j = rng.choices(range(len(choice)), choice)[0]
                if j < len(up):
                    up[j] += 1
                else:
                    up.append(1)
    return mass / b.c / (sweeps - burn)


def test_probabilities_are_those_of_the_whole_hierarchy():
    """Refreshes of the parent between sweeps, in one bucket and in three, against one customer at a time through both levels."""
    base = 200.0
    want = hierarchy(bucket(), base, 1.0, 300, 60, 5)
    u, w = tokens()
    for buckets in (1, 3):
        own = (X.pair_hash(u, w) % np.uint64(buckets)).astype(int)
        bs = []
        for k in range(buckets):
            b = X.Bucket.__new__(X.Bucket)
            b.seat(u[own == k], w[own == k])
            b.discount = bucket().discount  # small buckets would guess their own
            bs.append(b)
        sums, rounds = [np.zeros(len(b.c)) for b in bs], 250
        for r in range(rounds):
            stats = [X._stats(b, k, 1) for k, b in enumerate(bs)]
            back = X._parent(1, base, 1.0, 4, r)(pa.concat_tables(stats))
            for k, b in enumerate(bs):
                mine = back.filter(pa.compute.equal(back.column("bucket"), k))
                p, customers, tables, lone = X._from_parent(b, mine, base, 1.0)
                got = b.gibbs(p, customers, tables, 1.0, 1, 0, np.random.Generator(np.random.PCG64(1000 * r + k)), lone)
                if r >= 50:
                    sums[k] += got / (rounds - 50)
        ours, theirs = [], []
        whole = bucket()
        index = {(int(a), int(c)): i for i, (a, c) in enumerate(zip(whole.words[whole.context], whole.words[whole.dish], strict=True))}
        for b, x in zip(bs, sums, strict=True):
            for i in range(len(b.c)):
                at = index[int(b.words[b.context[i]]), int(b.words[b.dish[i]])]
                ours += [math.log(x[i])] * int(b.c[i])
                theirs += [math.log(want[at])] * int(b.c[i])
        assert abs(np.mean(ours) - np.mean(theirs)) < 0.01
        assert np.mean(np.abs(np.array(ours) - np.array(theirs))) < 0.03


def test_a_seating_comes_back_by_way_of_the_parent():
    b = bucket()
    given = X._from_parent(b, X._parent(1, 1000.0, 1.0, 4, 0)(X._stats(b, 0, 1)), 1000.0, 1.0)
    b.gibbs(*given[:3], 1.0, 3, 3, np.random.Generator(np.random.PCG64(1)), given[3])
    names = [(1, 1)]
    rows = pa.table({"bucket": pa.array([0], pa.int32()), "pass": pa.array([n for n, _ in names], pa.int64()), "kind": pa.array([k for _, k in names], pa.int32()), "data": pa.array([b""], pa.binary())})
    X.Bucket(rows)  # a bucket without tokens has none to seat
    own = pa.table({"part": pa.array([0], pa.int32()), "bucket": pa.array([-1], pa.int32()), "n": pa.array([len(b.seating)], pa.int32()), "data": pa.array([X.squeeze(X.planes(b.seating))], pa.binary())})
    back = X._parent(1, 1000.0, 1.0, 4, 1)(pa.concat_tables([X._stats(b, 0, 1), own]))
    assert sorted(back.column("part").to_pylist()) == [X.SEATING, 0] and set(back.column("bucket").to_pylist()) == {0}
    again = bucket()
    rest = X._go_on(again, back)
    assert rest.num_rows == 1 and np.array_equal(again.seating, b.seating) and np.array_equal(again.t, b.t) and b.t.sum() > len(b.t)
