"""Exact nearest neighbours by cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.vector import l2_normalize
from textloom.sources.shared import store

#: Numbers of the index's vectors that a task holds; scores that it makes at once; products that make a task of its own worth it.
CELL, BLOCK, WORK = 1 << 22, 1 << 21, 1 << 35


def build_index(vectors: DataFrame, id_column: str = "id", vector_column: str = "embedding") -> DataFrame:
    """(id, unit): rows without a vector are skipped; a zero vector stays zero. Ids must not repeat: `checked` says so."""
    return vectors.where(F.col(vector_column).isNotNull()).select(F.col(id_column).alias("id"), l2_normalize(F.col(vector_column)).alias("unit"))


def checked(index: DataFrame) -> DataFrame:
    """The index; ids that repeat, within it or with what was added, are a ValueError."""
    if not index.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("ids repeat")
    return index


def add(index: DataFrame, more: DataFrame) -> DataFrame:
    return checked(index.unionByName(more))


def clear(index: DataFrame) -> DataFrame:
    """The empty index of the same columns."""
    return index.limit(0)


def get_embedding(index: DataFrame, id_value) -> DataFrame:
    """(id, unit): normalised; no row for an unknown id."""
    return index.where(F.col("id") == F.lit(id_value))


def _classed(side: DataFrame) -> DataFrame:
    """(id, class, nth, unit): rows of equal vectors have the class of their least id and are numbered by id; only the first has its vector. Written once."""
    equal = Window.partitionBy("unit").orderBy("id")
    rows = side.select("id", "unit", F.first("id").over(equal).alias("class"), F.row_number().over(equal).alias("nth"))
    return store(rows.select("id", "class", "nth", F.when(F.col("nth") == 1, F.col("unit")).alias("unit")), "vector-classes")


def _true(flat: np.ndarray) -> np.ndarray:
    """Where a flat array of booleans is true, of which few are: eight are looked at together."""
    if len(flat) % 8:
        return np.flatnonzero(flat)
    some = np.flatnonzero(flat.view(np.uint64))
    i, j = np.nonzero(flat.reshape(-1, 8)[some])
    return some[i] * 8 + j


def _nearest(x: np.ndarray, y: np.ndarray, y32: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, score) of each row's k greatest cosines at or over the floor, rounded; ties go to the first rows of y.

    BLOCK scores at once are made in single precision; what could be among the best, by the bound of its
    error, is made again in double precision. A row with k of them raises its floor.
    """
    length = lambda z: np.nan_to_num(np.sqrt((z * z).sum(1)), nan=0.0, posinf=0.0).max(initial=0.0)
    error = (x.shape[1] + 8) * 2.0**-23 * max(1.0, length(x) * length(y)) + 1e-9
    rows = max(1, min(len(x), 512))
    step, at_once, out = max(k + 1, BLOCK // rows), max(1, (1 << 20) // max(1, x.shape[1])), []
    scores, hits = np.empty(rows * min(step, len(y)), np.float32), np.empty(rows * min(step, len(y)), bool)  # made anew for each block, they would cost more than the products
    for at in range(0, len(x), rows):
        q = x[at : at + rows]
        q32, low = q.astype(np.float32), np.full(len(q), float(floor))
        row, col, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for to in range(0, len(y), step):
            n = min(step, len(y) - to)
            near, over = scores[: len(q) * n].reshape(len(q), n), hits[: len(q) * n]
            np.matmul(q32, y32[to : to + n].T, out=near)
            np.greater_equal(near, (low - error).astype(np.float32)[:, None], out=over.reshape(len(q), n))
            hit = _true(over)
            if n > k and len(hit) > 8 * k * len(q):
                near[np.isnan(near)] = -3.0
                bound = np.partition(near, n - k, axis=1)[:, n - k].astype(np.float64)
                hit = np.flatnonzero(near >= (np.maximum(low, bound - error) - error).astype(np.float32)[:, None])
            if not len(hit):
                continue
            for z in range(0, len(hit), at_once):
                i, j = np.divmod(hit[z : z + at_once], n)
                j += to
                exact = np.round(np.einsum("ij,ij->i", q[i], y[j]), 9)
                ok = exact >= low[i]
                row, col, s = np.r_[row, i[ok]], np.r_[col, j[ok]], np.r_[s, exact[ok]]
                order = np.lexsort((col, -s, row))
                row, col, s = row[order], col[order], s[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, col, s = row[keep], col[keep], s[keep]
                number = np.bincount(row, minlength=len(q))
                full = number == k
                low[full] = np.nextafter(s[(np.cumsum(number) - 1)[full]], np.inf)  # a later one with the same score has a greater id
        out.append((row + at, col, s))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _runs(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of one cell and side at a time."""
    cell, side = np.asarray(b.column("cell")), np.asarray(b.column("side"))
    ends = np.r_[np.flatnonzero((cell[1:] != cell[:-1]) | (side[1:] != side[:-1])) + 1, len(cell)] if len(cell) else []
    at = 0
    for to in ends:
        yield b.slice(at, to - at)
        at = to


def _units(parts: list[pa.RecordBatch]) -> np.ndarray:
    flat = np.concatenate([np.asarray(p.column("unit").flatten(), np.float64) for p in parts])
    return flat.reshape(sum(p.num_rows for p in parts), -1)


def _compared(queries: DataFrame, index: DataFrame, k: int, floor: float, sizes: tuple[int, int, int]) -> DataFrame:
    """(id, neighbor, score): the k best of (id, unit) in each share of the index. sizes: of both sides, and of a vector."""
    n, m, d = sizes
    shares = max(1, math.ceil(m * d / CELL))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    groups = max(1, math.ceil(n * d / CELL), min(3 * cores // shares, math.ceil(n * m * d / shares / WORK)))
    cells = shares * groups
    kinds = [x.schema["id"].dataType.simpleString() for x in (queries, index)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, made = None, [], None
        for b in batches:
            for part in _runs(b):
                if part.column("cell")[0].as_py() != cell:
                    cell, held, made = part.column("cell")[0].as_py(), [], None
                if part.column("side")[0].as_py() == 0:
                    held.append(part)
                elif held or made:
                    if made is None:
                        y = _units(held)
                        made = pa.concat_arrays([p.column("own") for p in held]), y, y.astype(np.float32)
                        held = []
                    row, col, s = _nearest(_units([part]), *made[1:], k, floor)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([part.column("asked").take(pa.array(row)), made[0].take(pa.array(col)), pa.array(s)], ["id", "neighbor", "score"])

    def dealt(side: DataFrame, number: int, salt: int, own: int, others: int, cell, names: tuple[str, str]) -> DataFrame:
        share = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(own)).cast("int")
        ids = [F.col("id").alias(x) if x == names[0] else F.lit(None).cast(kinds[x == "own"]).alias(x) for x in ("asked", "own")]
        return side.select(F.lit(number).alias("side"), *ids, "unit", F.explode(F.transform(F.sequence(F.lit(0), F.lit(others - 1)), lambda o: cell(share, o).cast("int"))).alias("cell"))

    # The index comes first in its cell, by id, and is held; queries pass by.
    sides = dealt(index, 0, 2, shares, groups, lambda s, o: s * groups + o, ("own", "asked")).unionByName(dealt(queries, 1, 1, groups, shares, lambda s, o: o * groups + s, ("asked", "own")))
    # One partition would count as partitioned by anything, and all that follows would be one task.
    return sides.repartitionById(max(2, cells), "cell").sortWithinPartitions("cell", "side", "own").mapInArrow(run, f"id {kinds[0]}, neighbor {kinds[1]}, score double")


def top_k(queries: DataFrame, index: DataFrame, k: int = 10, threshold: float | None = None, exclude_self: bool = True) -> DataFrame:
    """(id, neighbor, score, rank): each query's k most similar, score at least the threshold, ties by id.

    Equal vectors are compared once: a class of them has its least id, and stands for its first ids. The
    first k + 1 ids in order are in the first k + 1 classes in order of score and least id, and are among
    the first k + 1 ids of each, so no more of either are needed, of which a query leaves out itself.

    Classes are dealt by a hash to shares of about CELL numbers of the index, and to groups of queries; a
    task holds one share of the index, in which queries are looked up as they come, in blocks. Each side is
    made once and travels as often as the other has shares or groups; only k + 1 rows a query and task leave it,
    and a window keeps the best. All pairs of classes are compared, as exact search without a
    metric bound does; none is broadcast or collected.
    """
    more = k + bool(exclude_self)
    floor = -2.0 if threshold is None else threshold
    known = _classed(index)
    asked = known if queries is index else _classed(queries)
    size = lambda side: side.agg(F.count("*").alias("rows"), F.count_if(F.col("nth") == 1).alias("n"), F.max(F.size("unit")).alias("d")).first()
    of_index = size(known)
    of_queries = of_index if asked is known else size(asked)
    first = lambda side: side.where("nth = 1").select("id", "unit")
    found = _compared(first(asked), first(known), more, floor, (of_queries["n"], of_index["n"], of_index["d"] or 1))
    ranked = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "neighbor"))
    if of_queries["rows"] == of_queries["n"] and of_index["rows"] == of_index["n"]:
        found = found.where(F.col("id") != F.col("neighbor")) if exclude_self else found
        return found.withColumn("rank", ranked).where(F.col("rank") <= k)
    best = found.withColumn("_nth", ranked).where(F.col("_nth") <= more).select(F.col("id").alias("asker"), F.col("neighbor").alias("class"), "score")
    heads = known.where(F.col("nth") <= more).select("class", F.col("id").alias("neighbor"))
    item = F.struct((-F.col("score")).alias("down"), "neighbor", "score")
    lists = best.join(heads, "class").groupBy("asker").agg(F.slice(F.array_sort(F.collect_list(item)), 1, more).alias("best"))
    rows = asked.select("id", F.col("class").alias("asker")).join(lists, "asker")
    own = F.filter("best", lambda x: x["neighbor"] != F.col("id")) if exclude_self else F.col("best")
    rows = rows.select("id", F.posexplode(F.slice(own, 1, k)).alias("place", "x"))
    return rows.select("id", F.col("x.neighbor").alias("neighbor"), F.col("x.score").alias("score"), (F.col("place") + 1).alias("rank"))


def search(index: DataFrame, query: list[float], k: int = 10, threshold: float | None = None, exclude: list | None = None) -> DataFrame:
    """(id, score): the k most similar to one vector that aren't excluded."""
    norm = float(np.linalg.norm(query)) or 1.0
    unit = F.array(*[F.lit(float(x) / norm) for x in query])
    score = F.round(F.aggregate(F.zip_with("unit", unit, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 9)
    rows = index.where(~F.col("id").isin(exclude)) if exclude else index
    rows = rows.select("id", score.alias("score"))
    if threshold is not None:
        rows = rows.where(F.col("score") >= threshold)
    return rows.orderBy(F.desc("score"), "id").limit(k)


def search_by_id(index: DataFrame, id_value, k: int = 10, threshold: float | None = None) -> DataFrame:
    found = index.where(F.col("id") == F.lit(id_value)).select("unit").first()
    if found is None:
        raise ValueError(f"{id_value} is not in the index")
    return search(index, list(found.unit), k, threshold, [id_value])


def candidate_pairs(neighbors: DataFrame) -> DataFrame:
    """(id_a, id_b, score): unordered pairs that either direction found, in the orientation of the lesser query, then rank."""
    key = neighbors.select("id", "neighbor", "score", "rank", F.least("id", "neighbor").alias("_lo"), F.greatest("id", "neighbor").alias("_hi"))
    first = key.groupBy("_lo", "_hi").agg(F.min_by(F.struct("id", "neighbor", "score"), F.struct("id", "rank")).alias("p"))
    return first.select(F.col("p.id").alias("id_a"), F.col("p.neighbor").alias("id_b"), F.col("p.score").alias("score"))


def with_contexts(pairs: DataFrame, contexts: DataFrame, keep: int = 3) -> DataFrame:
    """Candidate pairs with contexts_a and contexts_b: the first `keep` of (id, sample_contexts) of either side; none is an empty array."""
    kind = contexts.schema["sample_contexts"].dataType
    for x in "ab":
        own = contexts.select(F.col("id").alias(f"id_{x}"), F.slice("sample_contexts", 1, keep).alias(f"contexts_{x}"))
        pairs = pairs.join(own, f"id_{x}", "left").withColumn(f"contexts_{x}", F.coalesce(f"contexts_{x}", F.array().cast(kind)))
    return pairs
