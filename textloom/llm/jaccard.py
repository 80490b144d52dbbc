"""N-gram Jaccard self-join by chosen paths.

Sets of word n-grams are split on sampled shared tokens (Christiani and Pagh, 2017; the CPSJoin of
Christiani, Pagh and Sivertsen, 2018): in each run every set takes its minimum under that run's hash as
the token it is split on, so two sets of Jaccard similarity J meet with probability J. A small bucket is
compared by brute force. A large one is split again on further sampled coordinates, 1 / threshold of
them a level, so that a similar pair is expected to survive in one branch or more; sets whose mean
similarity to their bucket is over the threshold can't be split off and are compared with the whole
bucket first. Runs repeat until a pair at the threshold is missed with probability at most 1 - recall:
the first runs are as many as that takes where no bucket is split; sets that were in split buckets run
again among themselves, with fresh hashes, until what the depths of the splits let through is as little. A
pair with a set that was in none has lost nothing to splits.

Buckets are compared on sketches of one byte a coordinate; every pair that could reach the threshold
(three standard errors below it) is then verified on the whole sets, so all reported similarities are
exact and no reported pair is below the threshold.

Equal sets are a class that takes part once: copies are never expanded into pairs. `join` has one row a
document: class_id, the least doc_id of its connected component, and links, the number of other
documents that it is linked to, copies of each linked text included; no link between different texts is
lost. `pairs` has the pairs between classes of equal sets, by their least ids, and their members.

Many sets that nearly all resemble each other have pairs as the square of their number, in every run
again. Where a bucket has such a core its members are named as one group, not pair by pair; groups that are
mostly the same are one cluster, and all pairs of a cluster are verified once, on the whole sets, none of
them ever a row for `join` and `keep_one`: `join` takes from them sums of links and a forest of links,
`keep_one` only compares what isn't yet in one class. A pair that several clusters hold belongs to the least.
What is held at once is bounded: parts of PART_PAIRS pairs, cells of CELL_TOKENS.

A bucket beyond `heavy` sets, which one task should not hold, is split by further coordinates in Spark
before it is gathered; one whose sets agree too often for that is cut into blocks that meet two by two.

Defined results: a text without words (null, empty, or none but punctuation) has no set, is its own class
and has no links; a text of fewer words than n has one n-gram, all of it; a null id is left out of the
join, and kept by `keep_one`; rows that repeat id and text count once; an id with several texts is as many
documents, one row each; a class is named by its least id, so ties don't arise. A very long text is one
set, whole; it takes memory in proportion to itself. An empty table gives an empty result. Columns other
than id and text are not read, and are kept as they are by `keep_one`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from textloom.operators.graph import connected_components

from .frames import fresh, map_keyed, map_passes, row_key, store

WIDTH = 96  # coordinates of a sketch
FILTER_BITS = 1 << 26
CELL_TOKENS = 1 << 20  # of the sets that one call verifies, about; a cell of two slots has twice as many
PART_PAIRS = 1 << 18  # pairs that are held at once, about
DENSE_PAIRS, DENSE_DEGREE = 4096, 64  # least pairs of a core, and least pairs of each of its sets in the bucket
_MET = ["key", "a", "b", "size_a", "size_b", "depth", "core"]
_MET_SCHEMA = "key long, a long, b long, size_a long, size_b long, depth int, core long"
_rng = np.random.Generator(np.random.PCG64(0xC5))
_ODD = _rng.integers(0, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs_for(threshold: float, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold)))


def least_share(threshold: float) -> float:
    """Share of the sketch on which candidates agree: three standard errors below the threshold."""
    return max(0.0, threshold - 3 * math.sqrt(threshold * (1 - threshold) / WIDTH))


def missed(threshold: float, done: list[tuple[int, int]]) -> float:
    """Probability that (runs, depth of splits) all miss a candidate pair at the threshold.

    Splits of all runs are made on one sketch, so it is averaged over the share on which the pair agrees.
    """
    agree = np.arange(math.ceil(least_share(threshold) * WIDTH), WIDTH + 1)
    weight = np.array([math.comb(WIDTH, k) * threshold**k * (1 - threshold) ** (WIDTH - k) for k in agree.tolist()])
    left = np.ones(len(agree))
    for runs, depth in done:
        survives = np.ones(len(agree))
        for _ in range(depth):
            survives = 1 - (1 - agree / WIDTH * survives) ** math.ceil(1 / threshold)
        left *= (1 - threshold * survives) ** runs
    return float((weight * left).sum() / weight.sum())


def further_runs(threshold: float, recall: float, done: list[tuple[int, int]], depth: int, most: int) -> int:
    """Runs of splits to `depth` that bring what is missed down to 1 - recall, but `most` at once."""
    more = 1
    while more < most and missed(threshold, [*done, (more, depth)]) > 1 - recall:
        more += 1
    return more


def sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each text, sorted within it, flat; each text's first (one more at the end)."""
    buf, offsets = K.buffer(pc.utf8_lower(texts))
    starts, ends, counts = K.spans(buf, offsets)
    g, of = K.grams(K.hashes(buf, starts, ends), counts, n)
    order = np.lexsort((g, of))
    g, of = g[order], of[order]
    keep = np.r_[True, (g[1:] != g[:-1]) | (of[1:] != of[:-1])] if len(g) else np.zeros(0, bool)
    g, of = g[keep], of[keep]
    return g, np.searchsorted(of, np.arange(len(texts) + 1)), of


def _sketches(n: int, runs: int):
    """Every row with its set's name, tokens of all runs and sketch; a row without words has null ones."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        g, at, _ = sets(batch.column("text"), n)
        size = np.diff(at)
        has = np.flatnonzero(size)
        first = at[has]
        tokens, small, whole = np.empty((len(has), runs), np.uint64), np.empty((len(has), WIDTH), np.uint8), np.zeros(0, np.uint64)
        spare = np.empty((len(has), WIDTH - runs), np.uint32)
        if len(has):
            with np.errstate(over="ignore"):
                for j in range(WIDTH):
                    least = np.minimum.reduceat(g * _ODD[j], first)
                    if j < runs:
                        tokens[:, j] = K.mix(least + np.uint64(j))
                    mixed = K.mix(least)
                    small[:, j] = (mixed >> np.uint64(56)).astype(np.uint8)
                    if j >= runs:
                        spare[:, j - runs] = mixed.astype(np.uint32)
                whole = K.mix(np.add.reduceat(K.mix(g), first) + size[has].astype(np.uint64))
        fixed = lambda x: pa.FixedSizeBinaryArray.from_buffers(pa.binary(max(1, x.shape[1] * x.itemsize)), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary()) if x.shape[1] else pa.array([b""] * len(x), pa.binary())
        row = pa.array(np.cumsum(size > 0) - 1, mask=size == 0)  # a null index takes a null
        lists = K.lists(tokens.ravel().view(np.int64), np.arange(len(has) + 1) * runs)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rk"), pa.array(whole.view(np.int64)).take(row), pa.array(size), lists.take(row), fixed(small).take(row), fixed(spare).take(row)], ["doc_id", "rk", "rep", "size", "tokens", "sketch", "spare"])

    return work


def bucket_pairs(sketch: np.ndarray, size: np.ndarray, threshold: float, least: float, brute: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (indices) of one bucket, each once."""
    parts = list(bucket_parts(sketch, size, threshold, least, brute, seed))
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([x for x, _ in parts], [x for _, x in parts]))
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return both[:, 0], both[:, 1]


def bucket_parts(sketch: np.ndarray, size: np.ndarray, threshold: float, least: float, brute: int, seed: int, depth: int = 0, used: tuple[int, ...] = (), reached: list[int] | None = None, cores: list[np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs (indices) of one bucket in bounded parts, by recursion on sampled coordinates; a pair may repeat.

    reached: takes the depths of its splits. cores: takes the sets of each core, whose pairs among themselves don't follow.
    """
    m = len(sketch)
    if m < 2:
        return
    if m <= brute or len(used) >= WIDTH // 2:
        yield from _compared(sketch, size, [(np.arange(m), np.arange(m), True)], threshold, least, cores)
        return
    # Mean similarity to the bucket, from the frequency of each set's value in every coordinate.
    mean = np.zeros(m)
    for j in range(WIDTH):
        mean += np.bincount(sketch[:, j], minlength=256)[sketch[:, j]]
    close = mean / (WIDTH * m) >= threshold
    if close.any():
        rest = np.flatnonzero(~close)
        inside = np.flatnonzero(close)
        yield from _compared(sketch, size, [(inside, inside, True), (inside, rest, False)], threshold, least, cores)
    else:
        rest = np.arange(m)
    if len(rest) > 1:
        if reached is not None:
            reached.append(depth + 1)
        key = K.mix(np.array([seed + 0x9E37 * depth + sum(used) * 131], np.uint64))
        free = np.array([j for j in range(WIDTH) if j not in used])
        for b in range(math.ceil(1 / threshold)):
            j = int(free[int(K.mix(key + np.uint64(b))[0] % np.uint64(len(free)))])
            values = sketch[rest, j]
            order = np.argsort(values, kind="stable")
            for part in np.split(rest[order], np.flatnonzero(np.diff(values[order])) + 1):
                if len(part) > 1:
                    own = None if cores is None else []
                    for x, y in bucket_parts(sketch[part], size[part], threshold, least, brute, seed + b + 1, depth + 1, (*used, j), reached, own):
                        yield part[x], part[y]
                    if own:
                        cores += [part[x] for x in own]


def _compared(sketch, size, sides, threshold, least, cores) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of all sides (left, right, same) in bounded parts; those within a core are left out, and the core added to cores.

    A core are the sets with DENSE_DEGREE pairs or more, if a quarter of all their pairs or more are found, and DENSE_PAIRS.
    """
    hits = lambda: (x for left, right, same in sides for x in _hits(sketch, size, left, right, threshold, least, same))
    if cores is None or len(sketch) ** 2 < 2 * DENSE_PAIRS:
        yield from hits()
        return
    degree, held, n = np.zeros(len(sketch), np.int64), [], 0
    for a, b in hits():
        degree += np.bincount(a, minlength=len(degree)) + np.bincount(b, minlength=len(degree))
        n += len(a)
        held = [*held, (a, b)] if held is not None and n <= 4 * PART_PAIRS else None  # too many: found again
    core = degree >= DENSE_DEGREE
    inside = n - int(degree[~core].sum())  # at least so many are within
    if inside >= DENSE_PAIRS and 8 * inside >= int(core.sum()) ** 2:
        cores.append(np.flatnonzero(core))
    else:
        core[:] = False
    for a, b in hits() if held is None else held:
        out = ~(core[a] & core[b])
        if out.any():
            yield a[out], b[out]


def _hits(sketch, size, left, right, threshold, least, same) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of left x right (or within left) whose sketches agree on a share of `least` and whose sizes allow the threshold, in parts."""
    found_a, found_b, n = [], [], 0
    order = right[np.argsort(size[right], kind="stable")]
    sizes, bytes_ = size[order], sketch[order]
    place = {int(x): i for i, x in enumerate(order)} if same else {}
    need = math.ceil(least * WIDTH)
    for i in left.tolist():
        # J is at most the quotient of the sizes, so partners of a set lie in a range of sizes.
        low = place[i] + 1 if same else int(np.searchsorted(sizes, size[i] * threshold - 1e-9))
        high = int(np.searchsorted(sizes, size[i] / threshold + 1e-9, "right"))
        if high <= low:
            continue
        hit = np.flatnonzero((bytes_[low:high] == sketch[i]).sum(1, dtype=np.uint8) >= need)
        if len(hit):
            found_a.append(np.full(len(hit), i))
            found_b.append(order[low + hit])
            n += len(hit)
        if n >= PART_PAIRS:
            yield np.concatenate(found_a), np.concatenate(found_b)
            found_a, found_b, n = [], [], 0
    if n:
        yield np.concatenate(found_a), np.concatenate(found_b)


def _core_name(key: int, which: int, size: int) -> int:
    """A name for a core; the least name is of the largest."""
    return ((1 << 22) - min(size, (1 << 22) - 1)) << 40 | int(K.mix(np.array([(key + which * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0]) >> 24


def _candidates(threshold: float, brute: int):
    """Rows of buckets to candidate pairs; for each set of a split bucket a row with b null and the depth of its splits; for each set of a core one with b null and the core."""
    least = least_share(threshold)

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = rows.column("key").to_numpy()
        ids, size = rows.column("rep").to_numpy(), rows.column("size").to_numpy()
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, WIDTH)
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        sizes = np.diff(cuts)
        depth = rows.column("level").to_numpy()[cuts[:-1]].astype(np.int32)
        outs: list[tuple[np.ndarray, np.ndarray]] = []  # places of both sets
        held = 0

        def batch() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*outs, strict=True))
            a, b = a[ids[a] != ids[b]], b[ids[a] != ids[b]]
            a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
            return pa.RecordBatch.from_arrays([pa.array(keys[a]), pa.array(ids[a]), pa.array(ids[b]), pa.array(size[a]), pa.array(size[b]), pa.array(np.zeros(len(a), np.int32)), pa.nulls(len(a), pa.int64())], _MET)

        def sets_of(at: np.ndarray, depth: np.ndarray, core: pa.Array) -> pa.RecordBatch:
            none = pa.nulls(len(at), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(ids[at]), none, pa.array(size[at]), none, pa.array(depth), core], _MET)

        two = cuts[:-1][sizes == 2]  # most buckets by far: compared all at once
        if len(two):
            a, b = two, two + 1
            ok = ((sketch[a] == sketch[b]).sum(1) >= math.ceil(least * WIDTH)) & (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9)
            outs.append((a[ok], b[ok]))
        for i in np.flatnonzero(sizes > 2).tolist():
            own = slice(cuts[i], cuts[i + 1])
            reached, cores = [0], []
            for a, b in bucket_parts(sketch[own], size[own], threshold, least, brute, int(keys[cuts[i]]) & 0xFFFFFFFF, reached=reached, cores=cores):
                outs.append((a + cuts[i], b + cuts[i]))
                held += len(a)
                if held >= PART_PAIRS:
                    yield batch()
                    outs, held = [], 0
            depth[i] += max(reached)
            for which, core in enumerate(cores):
                yield sets_of(core + cuts[i], np.zeros(len(core), np.int32), pa.array(np.full(len(core), _core_name(int(keys[cuts[i]]), which, len(core)))))
        if outs:
            yield batch()
        depth = np.repeat(depth, sizes)
        split = np.flatnonzero(depth)
        if len(split):
            yield sets_of(split, depth[split], pa.nulls(len(split), pa.int64()))

    return work


def _present(names: DataFrame):
    """A broadcast bitmap with a bit for each name (rep) of the table: FILTER_BITS in all, however many there are. With more names it only lets more rows through."""
    at = F.pmod(F.col("rep"), F.lit(FILTER_BITS)) + 1
    rows = names.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:  # at most FILTER_BITS / 32768, of 4 kB
        bits[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return names.sparkSession.sparkContext.broadcast(bits)


def _is_present(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    at = names % FILTER_BITS
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _spare_tokens(runs: int, first: int, more: int):
    """Rows (rep, size, sketch, key) of `more` runs, numbered from `first`, from tokens that the sketches have left."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spare = np.frombuffer(b"".join(b.column("spare").to_pylist()), np.uint32).reshape(b.num_rows, -1)
            for j in range(first, first + more):
                key = K.mix(spare[:, j - runs].astype(np.uint64) + np.uint64(j << 32))
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("size"), b.column("sketch"), pa.array(key.view(np.int64))], ["rep", "size", "sketch", "key"])

    return work


def _more_tokens(n: int, first: int, runs: int, names):
    """Tokens of `runs` runs, numbered from `first`, for the sets named."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        g, at, _ = sets(batch.column("text"), n)
        size = np.diff(at)
        has = np.flatnonzero(size)
        if not len(has):
            return None
        with np.errstate(over="ignore"):
            whole = K.mix(np.add.reduceat(K.mix(g), at[has]) + size[has].astype(np.uint64)).view(np.int64)
            hit = _is_present(names.value, whole)
            if not hit.any():
                return None
            g, has, whole = g[np.repeat(hit, size[has])], has[hit], whole[hit]
            begin = np.cumsum(np.r_[0, size[has]])[:-1]
            tokens = np.empty((len(has), runs), np.uint64)
            for j in range(runs):
                odd = K.mix(np.array([first + j], np.uint64)) | np.uint64(1)
                tokens[:, j] = K.mix(np.minimum.reduceat(g * odd, begin) + np.uint64(first + j))
        return pa.RecordBatch.from_arrays([pa.array(whole), K.lists(tokens.ravel().view(np.int64), np.arange(len(has) + 1) * runs)], ["rep", "tokens"])

    return work


def _own_sets(n: int, names):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        g, at, _ = sets(batch.column("text"), n)
        size = np.diff(at)
        has = np.flatnonzero(size)
        if not len(has):
            return None
        with np.errstate(over="ignore"):
            whole = K.mix(np.add.reduceat(K.mix(g), at[has]) + size[has].astype(np.uint64))
        raw, offsets = g.tobytes(), np.r_[at[has], at[-1]] * 8
        packed = pa.Array.from_buffers(pa.binary(), len(has), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])
        hit = np.flatnonzero(_is_present(names.value, whole.view(np.int64)))  # sets without a candidate don't travel
        whole, packed = whole[hit], packed.take(pa.array(hit))
        return pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), packed], ["rep", "grams"])

    return work


def _verify(threshold: float):
    """Rows of a bucket: its sets (a is null) and its candidate pairs."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = rows.column("key").to_numpy()
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        is_set = rows.column("b").is_null().to_numpy()
        a_all, b_all = rows.column("a").to_numpy(), rows.column("b").fill_null(0).to_numpy()
        grams = rows.column("grams")
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = lo + np.flatnonzero(is_set[lo:hi])
            pairs = lo + np.flatnonzero(~is_set[lo:hi])
            if not len(pairs) or not len(own):
                continue
            held = [np.frombuffer(grams[i].as_py(), np.uint64) for i in own.tolist()]
            size = np.array([len(x) for x in held])
            begin = np.cumsum(np.r_[0, size])
            uniq, code = np.unique(np.concatenate(held), return_inverse=True)
            names = a_all[own]
            order = np.argsort(names, kind="stable")
            ia = order[np.searchsorted(names[order], a_all[pairs])]
            ib = order[np.searchsorted(names[order], b_all[pairs])]
            shared = np.empty(len(pairs), np.int64)
            mark = np.zeros(len(uniq), bool)
            by_a = np.argsort(ia, kind="stable")
            for group in np.split(by_a, np.flatnonzero(np.diff(ia[by_a])) + 1):
                x = ia[group[0]]
                mark[code[begin[x] : begin[x + 1]]] = True
                for p in group.tolist():
                    y = ib[p]
                    shared[p] = np.count_nonzero(mark[code[begin[y] : begin[y + 1]]])
                mark[code[begin[x] : begin[x + 1]]] = False
            j = shared / (size[ia] + size[ib] - shared)
            ok = j >= threshold - 1e-12
            out.append((a_all[pairs][ok], b_all[pairs][ok], j[ok]))
        if out:
            a, b, j = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(j)], ["a", "b", "jaccard"])

    return work


def _meet(rows: DataFrame, threshold: float, brute: int, heavy: int) -> DataFrame:
    """Candidates (key, a, b, depth) of runs' rows (rep, size, sketch, key); b is null for sets of split buckets, and for those of cores."""
    rows = rows.withColumn("level", F.lit(0))
    # Buckets too large for one task are split on, a coordinate at a time, until none is. A bucket whose sets
    # agree too often to be split off each other is cut into blocks instead, which meet two by two and lose nothing.
    branches, light, level = math.ceil(1 / threshold), None, 0
    while True:
        counts = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > heavy)
        if counts.isEmpty():
            break
        counts = store(counts, "heavy-buckets")
        part = rows.join(counts, "key", "left_anti")
        light = part if light is None else light.unionByName(part)
        rows = rows.join(counts, "key")
        places = F.explode(F.array(*[F.struct(F.lit(j).alias("at"), F.substring("sketch", j + 1, 1).alias("byte")) for j in range(0, WIDTH, 12)])).alias("z")
        seen = rows.select("key", "n", places).groupBy("key", "n", "z").agg(F.count("*").alias("m"))
        alike = seen.groupBy("key").agg((F.sum(F.col("m") / F.col("n") * F.col("m") / F.col("n")) / len(range(0, WIDTH, 12))).alias("share"))
        dense = alike.where((F.col("share") >= 0.8 * threshold) | F.lit(level >= WIDTH // 2)).select("key")
        light = light.unionByName(_cells(rows.join(dense, "key", "left_semi"), heavy))
        rows, level = rows.join(dense, "key", "left_anti"), level + 1
        step = F.pmod(F.xxhash64("key", F.lit(level), F.lit("step")), F.lit(WIDTH // branches))
        places = F.array(*[F.pmod(F.xxhash64("key", F.lit(level)) % WIDTH + step + F.lit(b * (WIDTH // branches)), F.lit(WIDTH)) for b in range(branches)])
        rows = rows.select("rep", "size", "sketch", "key", F.explode(places).alias("_at"))
        rows = store(rows.select("rep", "size", "sketch", F.xxhash64("key", "_at", F.substring("sketch", F.col("_at").cast("int") + 1, F.lit(1))).alias("key"), F.lit(level).alias("level")), "split-buckets")
    rows = rows if light is None else light.unionByName(rows)
    found = map_keyed(rows, "key", _candidates(threshold, brute), _MET_SCHEMA, least=20_000)
    return store(found.groupBy("a", "b", "core").agg(F.min("key").alias("key"), F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"), F.max("depth").alias("depth")), "candidates")


def _cells(rows: DataFrame, heavy: int) -> DataFrame:
    """Buckets (with n, their sets) as cells of two of their blocks each: any two sets of a bucket are together in one."""
    blocks = F.ceil(F.col("n") * 2 / heavy)
    own = F.pmod(F.xxhash64("rep", F.lit(11)), blocks)
    meets = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda other: F.xxhash64("key", F.least(other, own), F.greatest(other, own)))
    return rows.select("rep", "size", "sketch", F.explode(meets).alias("key"), "level")


def _verify_cluster(threshold: float, what: str):
    """Rows of a cell, all sets, to linked pairs (what: pairs), or to a forest of links and (links) sums of the copies that each set is linked to.

    A cell has the sets of one slot of a cluster, all pairs of which it compares, or of two, each pair across.
    """

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = rows.column("key").to_numpy()
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = rows.slice(lo, hi - lo).sort_by([("slot", "ascending"), ("rep", "ascending")])
            names, slot, copies = (own.column(c).to_numpy() for c in ("rep", "slot", "copies"))
            across = not own.column("one_slot")[0].as_py()
            m, cut = len(names), int(np.searchsorted(slot, slot[0], "right"))
            if m < 2 or across and cut == m:
                continue
            held = [np.frombuffer(x.as_buffer(), np.uint64) for c in own.column("grams").chunks for x in c]
            size = np.array([len(x) for x in held])
            begin = np.cumsum(np.r_[0, size])
            uniq, code = np.unique(np.concatenate(held), return_inverse=True)
            code, mark = code.astype(np.int32), np.zeros(len(uniq), np.uint8)
            del held, uniq
            before = _bits(own.column("before").to_pylist())
            root, far = np.arange(m), np.zeros(m, np.int64)
            outs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            n = 0
            for a in range(cut if across else m - 1):
                first = cut if across else a + 1
                open_ = np.minimum(size[first:], size[a]) >= threshold * np.maximum(size[first:], size[a]) - 1e-9
                if before is not None:
                    open_ &= ~(before[first:] & before[a]).any(1)  # those belong to a cluster before this
                if what == "forest":
                    open_ &= root[first:] != root[a]
                to = first + np.flatnonzero(open_)
                if not len(to):
                    continue
                mark[code[begin[a] : begin[a + 1]]] = 1
                if 4 * len(to) > m - first:
                    shared = np.add.reduceat(mark[code[begin[first] :]], begin[first:m] - begin[first], dtype=np.int64)[to - first]
                else:
                    shared = np.array([np.count_nonzero(mark[code[begin[b] : begin[b + 1]]]) for b in to.tolist()])
                mark[code[begin[a] : begin[a + 1]]] = 0
                j = shared / (size[a] + size[to] - shared)
                ok = j >= threshold - 1e-12
                to, j = to[ok], j[ok]
                if what != "pairs":
                    far[a] += copies[to].sum()
                    far[to] += copies[a]
                    new = root[to] != root[a]
                    to, j = to[new], j[new]
                    if len(to):
                        to, j = to[(first_of := np.unique(root[to], return_index=True)[1])], j[first_of]
                        root[np.isin(root, root[to])] = root[a]
                outs.append((np.full(len(to), a), to, j))
                n += len(to)
                if n >= PART_PAIRS:
                    yield _links(outs, names)
                    outs, n = [], 0
            if n:
                yield _links(outs, names)
            if what == "links":
                none = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(names), none, none.cast(pa.float64()), pa.array(far)], ["a", "b", "jaccard", "far"])

    return work


def _links(outs, names) -> pa.RecordBatch:
    a, b, j = (np.concatenate(x) for x in zip(*outs, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(names[a], names[b])), pa.array(np.maximum(names[a], names[b])), pa.array(j), pa.nulls(len(a), pa.int64())], ["a", "b", "jaccard", "far"])


def _bits(lists: list[list[int]]) -> np.ndarray | None:
    """A row of bits for each list, a bit for each value; two lists with a value in common have a bit in common. None: all are empty."""
    at = {x: i for i, x in enumerate(sorted({x for y in lists for x in y}))}
    if not at:
        return None
    bits = np.zeros((len(lists), -(-len(at) // 64)), np.uint64)
    for row, values in zip(bits, lists, strict=True):
        for i in map(at.get, values):
            row[i >> 6] |= np.uint64(1 << (i & 63))
    return bits


def _clusters(cores: DataFrame) -> DataFrame:
    """(rep, cluster, size), from (rep, core, size): a core of which half or more have the same largest core goes to that.

    So the cores that runs find of the same sets are one, and no chain of cores is. A set may be in several clusters.
    """
    home = cores.groupBy("rep").agg(F.min("core").alias("home"))
    votes = cores.join(home, "rep").groupBy("core", "home").agg(F.count("*").alias("n"))
    most = votes.groupBy("core").agg(F.sum("n").alias("all"), F.max(F.struct("n", "home")).alias("x"))
    to = most.select("core", F.when(F.col("x.n") * 2 >= F.col("all"), F.col("x.home")).otherwise(F.col("core")).alias("cluster"))
    return store(cores.join(to, "core").groupBy("rep", "cluster").agg(F.max("size").alias("size")), "clusters")


def _cluster_links(clusters: DataFrame, of: DataFrame, copies: DataFrame, kept: DataFrame, n: int, threshold: float, what: str) -> DataFrame:
    """(a, b, jaccard, far), all pairs of a cluster being compared, each pair in the least cluster that has both. of: (rep, all)."""
    slots = clusters.groupBy("cluster").agg(F.ceil(F.sum("size") / CELL_TOKENS).alias("slots"))
    own = F.pmod(F.xxhash64("rep", F.lit(13)), F.col("slots"))
    rows = clusters.join(slots, "cluster").join(of, "rep").join(copies, "rep").withColumn("slot", own)
    rows = rows.select("rep", "cluster", "slot", "copies", F.filter("all", lambda x: x < F.col("cluster")).alias("before"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("other"))
    rows = rows.select("rep", "slot", "copies", "before", F.xxhash64("cluster", F.least("slot", "other"), F.greatest("slot", "other")).alias("key"), (F.col("slot") == F.col("other")).alias("one_slot"))
    rows = rows.join(_grams(of.select("rep"), kept, n), "rep")
    return map_keyed(rows, "key", _verify_cluster(threshold, what), "a long, b long, jaccard double, far long", least=500)


def _grams(names: DataFrame, kept: DataFrame, n: int) -> DataFrame:
    """(rep, grams) of the sets named."""
    whole = map_passes(kept.select("text"), _own_sets(n, _present(names)), "rep long, grams binary")
    return whole.join(names, "rep", "left_semi").groupBy("rep").agg(F.first("grams").alias("grams"))


def _verified(found: DataFrame, kept: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the candidates (key, a, b, size_a, size_b) that reach the threshold.

    The sets of a bucket come to one place once, whatever number of pairs they are in. Buckets of more
    than CELL_TOKENS, or too many pairs, are cut into cells: a set has one of s slots, and a pair goes to the cell of its two slots.
    """
    sides = F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("size_a").alias("size")), F.struct(F.col("b").alias("rep"), F.col("size_b").alias("size")))).alias("x")
    needed = found.select("key", sides).select("key", "x.*").groupBy("key", "rep").agg(F.max("size").alias("size"), F.count("*").alias("n"))
    slots = needed.groupBy("key").agg(F.greatest(F.ceil(F.sum("size") / CELL_TOKENS), F.ceil(F.sqrt(F.sum("n") / (2 * PART_PAIRS)))).alias("slots")).where("slots > 1")
    slot = lambda c: F.pmod(F.xxhash64(c, F.lit(13)), F.coalesce("slots", F.lit(1)))
    placed = found.join(slots, "key", "left").select("a", "b", F.when(F.col("slots").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least(slot("a"), slot("b")), F.greatest(slot("a"), slot("b")))).alias("key"))
    placed = store(placed, "placed-candidates")
    needed = placed.select("key", F.explode(F.array("a", "b")).alias("rep")).distinct()
    names = store(needed.select("rep").distinct(), "needed")
    rows = needed.join(_grams(names, kept, n), "rep").select("key", F.col("rep").alias("a"), F.lit(None).cast("long").alias("b"), "grams")
    rows = rows.unionByName(placed.select("key", "a", "b", F.lit(None).cast("binary").alias("grams")))
    return map_keyed(rows, "key", _verify(threshold), "a long, b long, jaccard double", least=500)


def _found(docs: DataFrame, what: str, threshold: float = 0.5, n: int = 3, recall: float = 0.999, brute: int = 1500, heavy: int = 50_000) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(members: rep, doc_id, rk; pairs: a, b, jaccard of reps, a < b; what clusters have: pairs, links or forest, as of _verify_cluster). A rep is the hash of a distinct set; null for a row without words."""
    runs = min(runs_for(threshold, recall), WIDTH)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").withColumn("rk", row_key())
    sketched = store(map_passes(kept, _sketches(n, runs), "doc_id long, rk long, rep long, size long, tokens array<long>, sketch binary, spare binary"), "sketches")
    members = sketched.select("rep", "doc_id", "rk").distinct()
    reps = sketched.where("rep is not null").groupBy("rep").agg(F.first("size").alias("size"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    met = _meet(reps.select("rep", "size", "sketch", F.explode("tokens").alias("key")), threshold, brute, heavy)
    depth = met.where("b is null").agg(F.max("depth")).first()[0] or 0
    done, found, cores = [(runs, depth)], met.where("b is not null"), met.where("core is not null")
    if missed(threshold, done) > 1 - recall:
        split = met.where("b is null and core is null").select(F.col("a").alias("rep")).distinct()
        spare = sketched.where("rep is not null").groupBy("rep").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("spare").alias("spare"))
        again = store(spare.join(split, "rep", "left_semi"), "split-sets")
        names = None
        while missed(threshold, done) > 1 - recall:
            first = sum(x for x, _ in done)
            if first < WIDTH:  # on coordinates of the sketch that no run was on
                more = further_runs(threshold, recall, done, depth, WIDTH - first)
                rows = again.mapInArrow(_spare_tokens(runs, first, more), "rep long, size long, sketch binary, key long")
            else:  # on new ones
                more, names = further_runs(threshold, recall, done, depth, WIDTH), names or _present(again)
                tokens = map_passes(kept.select("text"), _more_tokens(n, first, more, names), "rep long, tokens array<long>").groupBy("rep").agg(F.first("tokens").alias("tokens"))
                rows = again.join(tokens, "rep").select("rep", "size", "sketch", F.explode("tokens").alias("key"))
            met = _meet(rows, threshold, brute, heavy)
            depth = met.where("b is null").agg(F.max("depth")).first()[0] or 0
            done.append((more, depth))
            found, cores = found.unionByName(met.where("b is not null")), cores.unionByName(met.where("core is not null"))
        found = store(found.groupBy("a", "b").agg(F.min("key").alias("key"), F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b")), "all-candidates")
    if cores.isEmpty():
        return members, _verified(found, kept, n, threshold), None
    clusters = _clusters(cores.select(F.col("a").alias("rep"), "core", F.col("size_a").alias("size")))
    of = store(clusters.groupBy("rep").agg(F.collect_list("cluster").alias("all")), "clusters-of-sets")
    sides = [of.select(F.col("rep").alias(c), F.col("all").alias(f"all_{c}")) for c in "ab"]
    found = found.join(sides[0], "a", "left").join(sides[1], "b", "left").where(~F.coalesce(F.arrays_overlap("all_a", "all_b"), F.lit(False))).select("key", "a", "b", "size_a", "size_b")
    copies = members.where("rep is not null").groupBy("rep").agg(F.count("*").alias("copies"))
    within = store(_cluster_links(clusters, of, copies, kept, n, threshold, what), "cluster-links")
    return members, _verified(store(found, "other-candidates"), kept, n, threshold), within


def set_pairs(docs: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """(members: rep, doc_id, rk; pairs: a, b, jaccard of reps, a < b). A rep is the hash of a distinct set; null for a row without words."""
    members, linked, within = _found(docs, "pairs", **how)
    return members, linked if within is None else linked.unionByName(within.select("a", "b", "jaccard"))


def pairs(docs: DataFrame, **how) -> DataFrame:
    """doc_a < doc_b, jaccard: the pairs between classes of equal sets, each class by its least id, and every other member of a class with that id (jaccard 1)."""
    members, linked = set_pairs(docs, **how)
    members = members.where("rep is not null")
    least = store(members.groupBy("rep").agg(F.min("doc_id").alias("x")), "representatives")
    across = linked.join(least.select(F.col("rep").alias("a"), "x"), "a").join(least.select(F.col("rep").alias("b"), F.col("x").alias("y")), "b")
    same = members.join(least, "rep").select("x", F.col("doc_id").alias("y"), F.lit(1.0).alias("jaccard"))
    return across.select("x", "y", "jaccard").unionByName(same).where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), F.round("jaccard", 9).alias("jaccard")).distinct()


def _classes(members: DataFrame, linked: DataFrame, within: DataFrame | None) -> DataFrame:
    """(rep, class_id, links): the least id of its connected component, and how many other documents each document with this set is linked to."""
    linked = store(linked, "linked-sets")
    sizes = store(members.where("rep is not null").groupBy("rep").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")), "set-sizes")
    both = linked.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(linked.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    links = both.join(sizes.select(F.col("rep").alias("other"), "copies"), "other").select("rep", F.col("copies").alias("far"))
    if within is not None:
        links = links.unionByName(within.where("far is not null").select(F.col("a").alias("rep"), "far"))
        linked = linked.select("a", "b").unionByName(within.where("b is not null").select("a", "b"))
    links = links.groupBy("rep").agg(F.sum("far").alias("far"))
    roots = connected_components(linked).select(F.col("node").alias("rep"), "root")
    rows = sizes.join(links, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    heads = rows.groupBy("root").agg(F.min("least").alias("class_id"))
    return rows.join(heads, "root").select("rep", "class_id", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("links"))


def join(docs: DataFrame, **how) -> DataFrame:
    """One row a document: doc_id, class_id, links. See the module for what they are."""
    members, linked, within = _found(docs, "links", **how)
    members = store(members, "members")
    found = members.join(_classes(members, linked, within), "rep", "left")
    return found.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The documents, all columns, but of each class only that of the least id.

    Rows that repeat id and text go or stay together; a null id stays.
    """
    members, linked, within = _found(docs, "forest", **how)
    members = store(members, "members")
    id_, rk = fresh(docs.columns, "_tl_id", "_tl_rk")
    gone = members.join(_classes(members, linked, within), "rep").where("doc_id > class_id").select(F.col("doc_id").alias(id_), F.col("rk").alias(rk)).distinct()
    keyed = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(rk, F.xxhash64(F.col(id_), F.col("text")))
    return keyed.join(gone, [id_, rk], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(threshold: float = 0.5, n: int = 3) -> str:
    """DuckDB: all pairs by their shared n-grams, components, and links; n is 3."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+') w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) >= {n} THEN list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) gram FROM d),
s AS (SELECT doc_id, count(*) n, md5(string_agg(gram, '|' ORDER BY gram)) sig FROM g GROUP BY 1),
c AS (SELECT sig, min(doc_id) rep, count(*) copies, any_value(n) n FROM s GROUP BY 1),
rg AS (SELECT g.doc_id rep, gram FROM g JOIN c ON c.rep = g.doc_id),
shared AS (SELECT a.rep a, b.rep b, count(*) k FROM rg a JOIN rg b USING (gram) WHERE a.rep < b.rep GROUP BY ALL),
linked AS (SELECT a, b FROM shared JOIN c ca ON ca.rep = a JOIN c cb ON cb.rep = b WHERE k / (ca.n + cb.n - k) >= {threshold} - 1e-12),
both_ AS (SELECT a u, b v FROM linked UNION SELECT b, a FROM linked),
reach(node, root) AS (SELECT rep, rep FROM c UNION SELECT v, root FROM reach JOIN both_ ON node = u),
m AS (SELECT node, min(root) class_id FROM reach GROUP BY 1),
far AS (SELECT u rep, sum(copies) far FROM both_ JOIN c ON c.rep = v GROUP BY 1)
SELECT documents.doc_id, coalesce(class_id, documents.doc_id) AS class_id, coalesce(copies - 1 + coalesce(far, 0), 0)::BIGINT AS links
FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN c USING (sig) LEFT JOIN m ON m.node = c.rep LEFT JOIN far ON far.rep = c.rep"""
