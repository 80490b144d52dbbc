import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from textloom.llm import jaccard as X

from .cases import documents, empty


def copies(spark, groups=30, size=6, seed=4):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(80)]
        for _ in range(size):
            words = [w if rng.random() > rng.choice([0, 0.02, 0.05, 0.1]) else f"edit{rng.randrange(10**6)}" for w in base]
            rows.append((len(rows), " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def brute(rows, threshold, n=3):
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        s = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        if s:
            sets[i] = s
    out = {}
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= threshold:
                out[a, b] = round(j, 9)
    return out


def expanded(docs, **how):
    """The pairs of documents that the pairs of classes and their members stand for."""
    found = {(r.doc_a, r.doc_b): r.jaccard for r in X.pairs(docs, **how).collect()}
    same = {}
    for (a, b), j in found.items():
        if j == 1:
            same.setdefault(min(a, b), {min(a, b)}).add(max(a, b))
    out = {}
    for (a, b), j in found.items():
        for x in same.get(a, {a}):
            for y in same.get(b, {b}):
                if x != y and j < 1:
                    out[min(x, y), max(x, y)] = j
    for members in same.values():
        out |= {(x, y): 1.0 for x in members for y in members if x < y}
    return out


def rows_of(want, ids):
    """doc_id: (class_id, links), from all pairs."""
    at = {i: i for i in ids}
    for _ in ids:
        for a, b in want:
            at[a] = at[b] = min(at[a], at[b])
    return {i: (at[i], sum(i in p for p in want)) for i in ids}


@pytest.mark.parametrize("how", [{}, {"brute": 4}, {"heavy": 5}])
def test_pairs_are_those_of_brute_force(spark, how):
    docs, rows = copies(spark)
    got, want = expanded(docs, **how), brute(rows, 0.5)
    assert all(want.get(k) == v for k, v in got.items())
    assert len(got) >= 0.99 * len(want)
    if not how:
        assert {r.doc_id: (r.class_id, r.links) for r in X.join(docs).collect()} == rows_of(got, [i for i, _ in rows])


def test_sets_that_no_coordinate_splits_meet_in_blocks(spark):
    # 30 sets that are almost equal: a token of each is its own, 400 are shared.
    shared = " ".join(f"s{i}" for i in range(400))
    rows = [(i, f"{shared} own{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in X.join(docs, heavy=6).collect()} == {(i, 0, 29) for i in range(30)}


def test_verification_in_cells(spark, monkeypatch):
    docs, rows = copies(spark, groups=4)
    monkeypatch.setattr(X, "CELL_TOKENS", 100)
    got = expanded(docs)
    assert got == {k: v for k, v in brute(rows, 0.5).items() if k in got} and len(got) > 30


def test_pairs_of_a_bucket_are_verified_in_cells_of_bounded_pairs(spark, monkeypatch):
    docs, _ = copies(spark, groups=4, size=40)
    names = sorted(r.rep for r in X.set_pairs(docs)[0].select("rep").distinct().collect())
    found = spark.createDataFrame([(7, a, b, 80, 80) for i, a in enumerate(names) for b in names[i + 1 :]], "key long, a long, b long, size_a long, size_b long")
    verified = lambda: {tuple(r) for r in X._verified(found, docs, 3, 0.5).collect()}
    whole = verified()
    keyed, most = X.map_keyed, []

    def seen(df, key, *rest, **how):
        most.append(max(r["count"] for r in df.where("b is not null").groupBy(key).count().collect()))
        return keyed(df, key, *rest, **how)

    monkeypatch.setattr(X, "map_keyed", seen)
    monkeypatch.setattr(X, "PART_PAIRS", 200)
    assert verified() == whole and len(whole) > 500
    assert len(most) == 1 and most[0] <= 4 * X.PART_PAIRS


def test_rows_of_a_group_are_held_once_while_they_are_worked_on():
    class Rows:
        sparkSession = type("S", (), {"conf": {"spark.sql.shuffle.partitions": "1"}})
        repartition = sortWithinPartitions = lambda self, *by: self
        mapInArrow = lambda self, run, schema: run

    def batches():
        for key in (1, 2, 2, 2, 3):
            yield pa.RecordBatch.from_arrays([pa.array([key] * 1000), pa.concat_arrays([pa.array([b"x" * 800] * 500)] * 2)], ["key", "grams"])

    before, held, got = pa.total_allocated_bytes(), [], []

    def work(rows):
        held.append((pa.total_allocated_bytes() - before) / 800_000)
        got.extend(pc.unique(rows.column("key")).to_pylist())
        yield from ()

    assert list(X.map_keyed(Rows(), "key", work, "")(batches())) == []
    # In batches: at most the three of a group and the one after it, and what the generator gave last.
    assert got == [1, 2, 3] and max(held) < 6.5


def test_bitmap_of_names(spark):
    names = spark.createDataFrame([(0,), (-1,), (5,), (2**62 + 11,)], "rep long")
    bits = X._present(names).value
    own = np.array([0, -1, 5, 2**62 + 11])
    assert X._is_present(bits, own).all() and not X._is_present(bits, own + 3).any()


def test_recursion_keeps_similar_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 256, (40, X.WIDTH), dtype=np.uint8)
    sketch = np.repeat(base, 20, 0)
    noise = rng.random(sketch.shape) < 0.1
    sketch[noise] = rng.integers(0, 256, int(noise.sum()))
    a, b = X.bucket_pairs(sketch, np.full(len(sketch), 100), 0.5, 0.35, 50, 1)
    same = {(i, j) for i in range(len(sketch)) for j in range(i + 1, len(sketch)) if i // 20 == j // 20}
    assert len(same & set(zip(a.tolist(), b.tolist()))) >= 0.9 * len(same)


def test_hostile_rows(spark):
    docs = documents(spark)
    got = {r.doc_id: (r.class_id, r.links) for r in X.join(docs).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2), **{i: (i, 0) for i in got if i > 3}}
    assert {4, 5, 6, 7, 9, 10, 12} <= set(got) and None not in got
    assert {(r.doc_a, r.doc_b) for r in X.pairs(docs).collect()} == {(1, 2), (1, 3)}
    kept = X.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and None in ids and {4, 5, 6, 7} <= set(ids)
    assert X.join(empty(spark)).count() == 0 and X.keep_one(empty(spark)).count() == 0


def test_a_chain_is_one_group(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(3, words[0:80]), (1, words[20:100]), (2, words[40:120])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert {(r.doc_a, r.doc_b) for r in X.pairs(docs).collect()} == {(1, 3), (1, 2)}
    assert {tuple(r) for r in X.join(docs).collect()} == {(1, 1, 2), (2, 1, 1), (3, 1, 1)}
    assert [r.doc_id for r in X.keep_one(docs).collect()] == [1]


def test_missed_pairs_by_depth():
    # Of 0.5 a coordinate in two branches, s' = s - s^2 / 4; the spread of sketches adds to what is missed.
    assert X.missed(0.5, [(10, 0)]) == pytest.approx(0.5**10)
    for depth, bare in ((1, 0.991), (2, 0.974), (6, 0.862)):
        assert 1 - 1.5 * (1 - bare) < 1 - X.missed(0.5, [(10, depth)]) < bare + 0.001
        done = [(10, depth)]
        while X.missed(0.5, done) > 0.001:
            done.append((X.further_runs(0.5, 0.999, done, depth, 10), depth))
        assert len(done) > 1


@pytest.mark.parametrize("how", [{"brute": 8}, {"brute": 200}])
def test_recall_of_deep_splits(spark, how):
    """A hot source: boilerplate that keeps buckets large, and pairs of Jaccard 0.5 to 0.6 in them."""
    rng = random.Random(9)
    boiler = [f"b{j}" for j in range(45)]
    rows = []
    for p in range(300):
        own = [f"p{p}w{j}" for j in range(48)]
        for _ in range(2):
            words = [w if rng.random() > 0.03 else f"e{rng.randrange(10**7)}" for w in own]
            for j in rng.sample(range(48), 4):
                words[j] = f"e{rng.randrange(10**7)}"
            rows.append((len(rows), " ".join(boiler + words)))
    want = {k: j for k, j in brute(rows, 0.5).items() if j < 0.6}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = expanded(docs, **how)
    assert len(want) > 60 and all(got[k] == want[k] for k in got.keys() & want.keys())
    assert len(got.keys() & want.keys()) >= 0.99 * len(want)


def near_copies(m, noise, seed=5):
    """Sketches of m sets that are near copies of one."""
    rng = np.random.default_rng(seed)
    sketch = np.repeat(rng.integers(0, 256, (1, X.WIDTH), dtype=np.uint8), m, 0)
    other = rng.random(sketch.shape) < noise
    sketch[other] = rng.integers(0, 256, int(other.sum()))
    return sketch


@pytest.mark.parametrize("brute", [1500, 5000])
def test_a_bucket_of_near_copies_sends_no_pairs(brute):
    m, alone = 3000, 40
    sketch = np.concatenate([near_copies(m, 0.1), np.random.default_rng(1).integers(0, 256, (alone, X.WIDTH), dtype=np.uint8)])
    n = len(sketch)
    rows = pa.table({"key": np.full(n, 7), "rep": np.arange(n), "size": np.full(n, 100), "sketch": [bytes(x) for x in sketch], "level": np.zeros(n, np.int32)})
    got = list(X._candidates(0.5, brute)(rows))
    assert sum(x.num_rows for x in got) <= 3 * n and max(x.num_rows for x in got) <= n
    cores = pa.Table.from_batches(got).filter(pc.field("core").is_valid())
    assert set(range(m)) <= set(cores.column("a").to_pylist())


def test_pairs_of_a_bucket_without_a_core_come_in_parts():
    # 40 kinds of 50 near copies: no set has enough pairs to be in a core.
    sketch = np.concatenate([near_copies(50, 0.1, seed) for seed in range(40)])
    size, cores = np.full(len(sketch), 100), []
    parts = list(X.bucket_parts(sketch, size, 0.5, 0.35, 5000, 1, cores=cores))
    whole = {(min(x, y), max(x, y)) for a, b in parts for x, y in zip(a.tolist(), b.tolist())}
    assert not cores and whole == set(zip(*(x.tolist() for x in X.bucket_pairs(sketch, size, 0.5, 0.35, 5000, 1)))) and len(whole) >= 40 * 50 * 49 / 2
    many = near_copies(1200, 0.1)
    assert max(len(a) for a, _ in X._hits(many, np.full(1200, 100), np.arange(1200), np.arange(1200), 0.5, 0.35, True)) < X.PART_PAIRS + 1200


@pytest.mark.parametrize("how", ["one cell", "cells", "overlapping clusters"])
def test_clusters_of_near_copies_lose_no_link(spark, monkeypatch, how):
    """Two kinds of 150 texts that nearly all resemble each other, copies of some, and others that resemble a few of them."""
    docs, rows = copies(spark, groups=2, size=150, seed=8)
    rows += [(1000 + i, rows[7 * i][1]) for i in range(12)]
    rows += [(2000 + i, " ".join(rows[3 * i][1].split()[:46] + [f"n{i}x{j}" for j in range(30)])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if how != "one cell":
        monkeypatch.setattr(X, "CELL_TOKENS", 3000)
    merged = X._clusters
    seen = []

    def clusters(cores):
        out = merged(cores) if how != "overlapping clusters" else cores.select("rep", X.F.col("core").alias("cluster"), "size").distinct()
        seen.append(out.count())
        return out

    monkeypatch.setattr(X, "_clusters", clusters)
    want = brute(rows, 0.5)
    ids = [i for i, _ in rows]
    got = {r.doc_id: (r.class_id, r.links) for r in X.join(docs).collect()}
    assert seen[0] >= 250 and got == rows_of(want, ids)
    assert expanded(docs) == want
    assert {r.doc_id for r in X.keep_one(docs).collect()} == {c for c, _ in rows_of(want, ids).values()}


def test_join_takes_sums_of_links_from_a_cluster():
    rng = np.random.default_rng(2)
    m, base = 300, rng.integers(0, 2**63, 80, dtype=np.uint64)
    held = [np.sort(np.where(rng.random(80) < 0.2, rng.integers(0, 2**63, 80, dtype=np.uint64), base)) for _ in range(m)]
    copies = rng.integers(1, 4, m)
    cell = pa.table({"key": np.full(m, 1), "rep": np.arange(m), "slot": np.zeros(m, np.int64), "copies": copies, "one_slot": np.ones(m, bool), "before": pa.array([[]] * m, pa.list_(pa.int64())), "grams": [x.tobytes() for x in held]})
    linked = np.array([[len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.5 for y in held] for x in held]) & ~np.eye(m, dtype=bool)
    got = pa.Table.from_batches(list(X._verify_cluster(0.5, "links")(cell))).to_pylist()
    assert len(got) < 2 * m < linked.sum() / 2
    assert {r["a"]: r["far"] for r in got if r["b"] is None} == dict(enumerate((linked @ copies).tolist()))
    assert all(linked[r["a"], r["b"]] for r in got if r["b"] is not None)
