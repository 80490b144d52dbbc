import numpy as np
import pytest
from textloom.llm import ego as X


def classes(n, edges):
    at = list(range(n))
    for _ in range(n):
        for a, b in edges:
            at[a] = at[b] = min(at[a], at[b])
    return at


@pytest.mark.parametrize("cell", [16, None])
def test_pairs_and_classes_are_those_of_brute_force(spark, cell):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:30] + rng.normal(size=(30, 16)) * 0.1, base[:10] + rng.normal(size=(10, 16)) * 0.25]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j, round(s[i, j], 5)) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= 0.95}
    assert len(want) > 20
    assert {tuple(r) for r in X.pairs(df, cell=cell).collect()} == want
    class_of = classes(len(x), [(a, b) for a, b, _ in want])
    links = [sum(i in (a, b) for a, b, _ in want) for i in range(len(x))]
    assert {tuple(r) for r in X.join(df, cell=cell).collect()} == {(i, class_of[i], links[i]) for i in range(len(x))}


def test_dimensions_are_joined_each_for_itself(spark):
    rows = [(i, [1.0 + i / 50, 1.0, 2.0]) for i in range(4)] + [(10 + i, [3.0, 1.0 + i / 50]) for i in range(3)] + [(20, [1.0])]
    got = {r.vec_id: (r.class_id, r.links) for r in X.join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {**{i: (0, 3) for i in range(4)}, **{10 + i: (10, 2) for i in range(3)}, 20: (20, 0)}


def test_stars():
    rng = np.random.default_rng(3)
    edges = rng.integers(0, 60, (40, 2))
    assert X.stars(60, edges[:, 0], edges[:, 1]).tolist() == classes(60, edges.tolist())


def test_intervals_skip_nothing_within_eps():
    rng = np.random.default_rng(1)
    a = np.sort(rng.random((900, 3)), 0)
    p, q = X.interval_join(a, a, 0.05, True, small=8)
    d = ((a[:, None] - a) ** 2).sum(2)
    assert set(zip(p.tolist(), q.tolist())) == {(i, j) for i, j in zip(*np.nonzero(d <= 0.05**2)) if i < j}


def test_hostile_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, "a"), (2, v, "a"), (2, v, "a"), (3, None, None), (4, [], "a"), (5, [0.0] * 3, "a"), (6, [float("nan"), 1.0, 1.0], "a"), (7, [1.0, None, 3.0], "a"), (8, [1.0, 2.0], "a"), (None, v, "a"), (9, [-1.0, -2.0, -3.0], "a"), (10, [2.0, 4.0, 6.1], "a"), (11, [float("inf"), 1.0, 1.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string")
    assert sorted((r.vec_a, r.vec_b) for r in X.pairs(df).collect()) == [(1, 10)]
    got = sorted((r.vec_id, r.class_id, r.links) for r in X.join(df).collect())
    assert got == [(1, 1, 2), (2, 1, 2), *((i, i, 0) for i in range(3, 10)), (10, 1, 2), (11, 11, 0)]
    assert X.join(df.limit(0)).count() == 0 and X.pairs(df.limit(0)).count() == 0
    assert {r.links for r in X.join(df.where("vec_id in (3, 4)")).collect()} == {0}
    twice = spark.createDataFrame([(1, v), (1, [9.0, 1.0, 0.0]), (2, [9.0, 1.0, 0.1])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in X.join(twice).collect()) == [(1, 1, 0), (1, 1, 1), (2, 1, 1)]
