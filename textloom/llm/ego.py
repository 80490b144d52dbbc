"""Embedding near-duplicates by the epsilon grid order join.

All pairs of vectors with cosine at or over a threshold, exactly: unit vectors lie within
eps = sqrt(2 - 2 cosine) of each other. Vectors are rotated to their principal axes, which keeps
distances and puts variance in front, and sorted by the grid cells (of width eps) of the leading axes:
the epsilon grid order (Boehm, Braunmueller, Krebs and Kriegel, 2001). The order is cut into sequences,
with bounding boxes; two sequences whose boxes are all further apart than eps are never brought together,
and those that aren't are joined by recursion: of each pair of intervals the longer is halved, pairs of
intervals whose boxes are provably distant are skipped, and small pairs are compared by one matrix
product in double precision.

The order comes from a range partitioning, boxes are matched by an equi-join on the cells of the first
axis that they touch, and two sequences that may have partners in each other meet in a task, which holds
two sequences whatever their partners. Vectors travel in the precision that they are stored in.
Sequences grow with the square root of the number of vectors, so a vector travels to at most about as
many tasks as there are sequences: where no axis tells vectors apart, the work is that of all pairs.

Equal vectors are one class that takes part once, so copies are never expanded into pairs, and a task of
`join` sends no pairs: for each vector the number of its partners, and a spanning star of each group that
hangs together in the task. `join` has one row a vector: class_id, the least id of its connected
component, and links, how many other vectors it is linked to, copies included. `pairs` has the pairs
between classes of equal vectors, by their least ids.

Defined results: null, empty, zero and non-finite vectors are their own class and have no links; vectors
are joined within their dimension; a null id is left out; rows that repeat id and vector count once, an id with
several vectors is as many vectors, one row each; an empty table gives an empty result. Ties don't arise.
Very long vectors take memory in proportion to the square of their length (their axes). Columns other than
id and vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.graph import connected_components

from .frames import map_keyed, store


BOXES = 4  # of a sequence
CELL_BYTES = 64 << 20  # of the vectors of a sequence, in double precision


def _matrix(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors, as they are stored, and the rows that have one."""
    lists = batch.column("v")
    size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), -1))
    rows = np.flatnonzero(size == dim)
    flat = lists.take(pa.array(rows)).flatten()
    x = np.asarray(pa.compute.fill_null(flat, float("nan"))).reshape(-1, dim)
    norm = _norms(x)
    ok = np.isfinite(norm) & (norm > 0)
    return x[ok], rows[ok]


def _norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        x = x.astype(np.float64)
        return np.sqrt((x * x).sum(1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) / _norms(x)[:, None]


def axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Principal axes of the unit vectors, most variance first; sums are added up in Spark, dim squared numbers reach the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for b in batches:
            x = _unit(_matrix(b, dim)[0])
            y = np.c_[np.ones(len(x)), x]
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange((dim + 1) ** 2)), pa.array(total.ravel())], ["at", "x"])

    rows = vectors.mapInArrow(sums, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((dim + 1) ** 2)
    for r in rows:
        total[r["at"]] = r["x"]
    total = total.reshape(dim + 1, dim + 1)
    n = max(total[0, 0], 1.0)
    mean = total[0, 1:] / n
    _, found = np.linalg.eigh(total[1:, 1:] / n - np.outer(mean, mean))
    return found[:, ::-1]


def stars(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that edges (p, q) connect it with."""
    at = np.arange(n)
    while True:
        low = np.minimum(at[p], at[q])
        new = at.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        np.minimum.at(new, at[p], low)
        np.minimum.at(new, at[q], low)
        new = new[new]
        if (new == at).all():
            return at
        at = new


def interval_join(a: np.ndarray, b: np.ndarray, eps: float, same: bool, small: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of a and b within eps; i < j if both are the same sequence."""
    limit, out = eps * eps * (1 + 1e-9) + 1e-15, []
    boxes: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(which: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        key = (which, lo, hi)
        if key not in boxes:
            x = (b if which else a)[lo:hi]
            boxes[key] = (x.min(0), x.max(0))
        return boxes[key]

    todo = [(0, len(a), 0, len(b))] if len(a) and len(b) else []
    while todo:
        i, j, k, m = todo.pop()
        if same and m <= i + 1:
            continue
        (la, ha), (lb, hb) = box(0, i, j), box(0 if same else 1, k, m)
        gap = np.maximum(0, np.maximum(lb - ha, la - hb))
        if gap @ gap > limit:
            continue
        if j - i <= small and m - k <= small:
            x, y = a[i:j], b[k:m]
            d = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)
            p, q = np.nonzero(d <= limit + 1e-12)
            p, q = p + i, q + k
            if same:
                p, q = p[p < q], q[p < q]
            out.append((p, q))
        elif j - i >= m - k:
            h = (i + j) // 2
            todo += [(i, h, k, m), (h, j, k, m)]
        else:
            h = (k + m) // 2
            todo += [(i, j, k, h), (i, j, h, m)]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p for p, _ in out]), np.concatenate([q for _, q in out])


def _entries(vectors: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, DataFrame]:
    """(members: id, rep; classes: rep, least, copies, v) of equal vectors. rep is null without a vector."""
    kind = vectors.schema[vector_column].dataType.simpleString()
    v = F.col(vector_column) if kind in ("array<float>", "array<double>") else F.col(vector_column).cast("array<double>")
    rows = store(vectors.select(F.col(id_column).cast("long").alias("id"), F.when(F.size(v) > 0, v).alias("v")).where("id is not null").distinct(), "vectors")
    # Names are given before they are written, and never again.
    classes = store(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()), "equal-vectors")
    return rows.join(classes.select("v", "rep"), "v", "left").select("id", "rep"), classes


def _sequences(classes: DataFrame, dim: int, count: int, eps: float, turn, leading: int, cell: int) -> DataFrame:
    """The grid order of the vectors of one dimension, cut into rows of about `cell` vectors, each with a few boxes."""
    leading = min(leading, dim)
    names = [f"c{i}" for i in range(leading)]
    single = classes.schema["v"].dataType.simpleString() == "array<float>"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, own = _matrix(b, dim)
            cells = np.floor((_unit(x) @ turn.value[:, :leading]) / eps).astype(np.int32)
            at = pa.array(own)
            yield pa.RecordBatch.from_arrays([b.column("rep").take(at), b.column("copies").take(at), pa.array([r.tobytes() for r in x], pa.binary()), *[pa.array(cells[:, i]) for i in range(leading)]], ["rep", "copies", "x", *names])

    placed = classes.where(F.size("v") == dim).mapInArrow(place, "rep long, copies long, x binary, " + ", ".join(f"{c} int" for c in names))
    ordered = placed.repartitionByRange(max(1, math.ceil(count / cell)), *names, "rep").sortWithinPartitions(*names, "rep")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def emit(t: pa.Table) -> pa.RecordBatch:
            nonlocal seq
            raw = b"".join(t.column("x").to_pylist())
            x = _unit(np.frombuffer(raw, np.float32 if single else np.float64).reshape(-1, dim)) @ turn.value
            begin = np.unique(np.arange(0, len(x), max(1, -(-len(x) // BOXES))))
            seq += 1
            ids, copies = (t.column(c).to_numpy().astype(np.int64).tobytes() for c in ("rep", "copies"))
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq]), pa.array([ids]), pa.array([copies]), pa.array([raw]), pa.array([np.minimum.reduceat(x, begin).tolist()]), pa.array([np.maximum.reduceat(x, begin).tolist()])], ["grp", "ids", "copies", "x", "lo", "hi"])

        for b in batches:
            held.append(b)
            while sum(h.num_rows for h in held) >= 2 * cell:
                t = pa.Table.from_batches(held)
                yield emit(t.slice(0, cell))
                held = t.slice(cell).to_batches()
        if sum(h.num_rows for h in held):
            yield emit(pa.Table.from_batches(held))

    return ordered.mapInArrow(cut, "grp long, ids binary, copies binary, x binary, lo array<array<double>>, hi array<array<double>>")


def _found(classes: DataFrame, cosine: float, leading: int, cell: int | None, whole: bool) -> DataFrame:
    """whole: (vec_a, vec_b, cosine) of all pairs; else (rep, links, head), for each task that found partners of rep."""
    spark, eps = classes.sparkSession, math.sqrt(max(0.0, 2 - 2 * cosine)) or 1e-9
    schema = "vec_a long, vec_b long, cosine double" if whole else "rep long, links long, head long"
    out = spark.createDataFrame([], schema)
    for row in classes.groupBy(F.size("v").alias("dim")).count().where("count > 1").orderBy("dim").collect():
        out = out.unionByName(_of_dimension(classes, row["dim"], row["count"], cosine, eps, leading, cell, whole, schema))
    return out


def _of_dimension(classes: DataFrame, dim: int, count: int, cosine: float, eps: float, leading: int, cell: int | None, whole: bool, schema: str) -> DataFrame:
    turn = classes.sparkSession.sparkContext.broadcast(axes(classes.where(F.size("v") == dim), dim))
    cell = cell or min(max(8192, int(36 * math.sqrt(count))), max(8192, CELL_BYTES // (8 * dim)))
    stored = store(_sequences(classes, dim, count, eps, turn, leading, cell), "ego-sequences")
    single = classes.schema["v"].dataType.simpleString() == "array<float>"
    cell_of = lambda c: F.floor(c / F.lit(eps)).cast("int")
    box = stored.select("grp", F.explode(F.arrays_zip("lo", "hi")).alias("z")).select("grp", "z.lo", "z.hi")
    wide = box.select("grp", "lo", "hi", F.explode(F.sequence(cell_of(F.col("lo")[0]) - 1, cell_of(F.col("hi")[0]) + 1)).alias("cell"))
    near = box.select(F.col("grp").alias("g2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.explode(F.sequence(cell_of(F.col("lo")[0]), cell_of(F.col("hi")[0]))).alias("cell"))
    gap = F.aggregate(F.arrays_zip(F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("lo2").alias("c"), F.col("hi2").alias("d")), F.lit(0.0), lambda s, z: s + F.pow(F.greatest(F.lit(0.0), z["c"] - z["b"], z["a"] - z["d"]), 2))
    meets = wide.join(near, "cell").where(F.col("grp") <= F.col("g2")).where(gap <= eps * eps * (1 + 1e-9) + 1e-12).select("grp", "g2").distinct()
    meets = meets.select("grp", "g2", F.concat_ws("-", "grp", "g2").alias("key"))
    data = stored.select("grp", "ids", "copies", "x")
    left = meets.join(data, "grp").select("key", F.when(F.col("g2") == F.col("grp"), 0).otherwise(1).alias("kind"), "ids", "copies", "x")
    right = meets.where("g2 <> grp").join(data.withColumnRenamed("grp", "g2"), "g2").select("key", F.lit(2).alias("kind"), "ids", "copies", "x")

    def match(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, kinds = rows.column("key").to_pylist(), rows.column("kind").to_pylist()
        longs = lambda c, i: np.frombuffer(rows.column(c)[i].as_py(), np.int64)
        xs = lambda i: _unit(np.frombuffer(rows.column("x")[i].as_py(), np.float32 if single else np.float64).reshape(-1, dim)) @ turn.value
        for i, kind in enumerate(kinds):  # sorted: a pair's right sequence follows its left one
            if kind == 2:
                continue
            if kind == 1 and (i + 1 >= len(keys) or keys[i + 1] != keys[i]):
                raise ValueError(f"sequences {keys[i]} came apart")
            a, ids, copies = xs(i), longs("ids", i), longs("copies", i)
            n, b = len(ids), a
            if kind:
                b, ids, copies = xs(i + 1), np.r_[ids, longs("ids", i + 1)], np.r_[copies, longs("copies", i + 1)]
            p, q = interval_join(a, b, eps, kind == 0)
            c = (a[p] * b[q]).sum(1)
            ok = c >= cosine - 1e-12
            p, q, c = p[ok], q[ok] + (n if kind else 0), c[ok]
            if not len(p):
                continue
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[p], ids[q])), pa.array(np.maximum(ids[p], ids[q])), pa.array(c)], ["vec_a", "vec_b", "cosine"])
                continue
            links = np.bincount(p, copies[q], len(ids)) + np.bincount(q, copies[p], len(ids))
            has = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(links[has].astype(np.int64)), pa.array(ids[stars(len(ids), p, q)[has]])], ["rep", "links", "head"])

    return map_keyed(left.unionByName(right), "key", match, schema, order=("kind",))


def pairs(vectors: DataFrame, cosine: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding", leading: int = 8, cell: int | None = None) -> DataFrame:
    """vec_a < vec_b, cosine: all pairs of classes of equal vectors at or over the threshold, by their least ids; none of an id with itself."""
    _, classes = _entries(vectors, id_column, vector_column)
    found, names = _found(classes, cosine, leading, cell, True), classes.select("rep", "least")
    named = found.join(names.toDF("vec_a", "x"), "vec_a").join(names.toDF("vec_b", "y"), "vec_b").where("x <> y")
    return named.select(F.least("x", "y").alias("vec_a"), F.greatest("x", "y").alias("vec_b"), F.round("cosine", 5).alias("cosine"))


def join(vectors: DataFrame, cosine: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding", leading: int = 8, cell: int | None = None) -> DataFrame:
    """One row a vector: vec_id, class_id, links."""
    members, classes = _entries(vectors, id_column, vector_column)
    found = store(_found(classes, cosine, leading, cell, False), "ego-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("far"))
    roots = connected_components(found, "rep", "head").select(F.col("node").alias("rep"), "root")
    per = classes.select("rep", "least", "copies").join(links, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    heads = per.groupBy("root").agg(F.min("least").alias("class_id"))
    per = per.join(heads, "root").select("rep", "class_id", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
    out = members.join(per, "rep", "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def oracle(cosine: float = 0.95) -> str:
    unit = "SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) v FROM embeddings"
    return f"""WITH RECURSIVE e AS ({unit}), p AS (SELECT a.vec_id u, b.vec_id w FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= {cosine}),
reach(node, root) AS (SELECT vec_id, vec_id FROM e UNION SELECT w, root FROM reach JOIN p ON node = u),
m AS (SELECT node, min(root) class_id FROM reach GROUP BY 1), l AS (SELECT u, count(*) links FROM p GROUP BY 1)
SELECT vec_id, class_id, coalesce(links, 0)::BIGINT AS links FROM e JOIN m ON node = vec_id LEFT JOIN l ON u = vec_id"""


def pairs_oracle(cosine: float) -> str:
    """For tables without equal vectors."""
    return f"""WITH e AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) v FROM embeddings), p AS (SELECT a.vec_id vec_a, b.vec_id vec_b, list_cosine_similarity(a.v, b.v) c FROM e a JOIN e b ON a.vec_id < b.vec_id)
SELECT vec_a, vec_b, round(c, 5) AS cosine FROM p WHERE c >= {cosine}"""
