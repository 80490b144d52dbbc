"""Shortest-pack-first packing over the length histogram.

The histogram of lengths has at most `max_len` bars, whatever the size of the corpus, so the packing is
decided on it alone (Krell, Kosec, Perez and Fitzgibbon, 2021): lengths are placed longest first, each
into the shortest open pack, that is the packing pattern with the most room. A pattern that stands for n
packs and takes m < n texts splits into one of m with the text and one of n - m without. The patterns
are then joined back to documents by rank: the texts of one length are numbered, and each slot of a
pattern owns a run of ranks of its length.

Ranks come without a global sort or a single-partition window: a text is numbered within its partition
and length while it is read, and the counts of (partition, length) are summed up afterwards.

A text longer than `max_len` is cut into pieces of `max_len` and a rest, so every token is packed. Tokens
are white-space separated words unless `starts` gives others. Each row carries the text of its piece, up to
where the next begins, so a text is its pieces in order and a pack is its rows by position: nothing else is
needed to train on it.

Defined results: null and empty texts, and those of white space only, have no tokens and are in no pack; repeated rows are packed as
often as they occur; equal lengths are ranked by partition and order in it; an empty table gives an empty
result; a null id is kept; a very long text takes memory in proportion to itself. Columns other than id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .frames import store

PIECES = "doc_id long, piece int, start int, length int, text string, part int, nth long"
OUT = "pack_id long, position int, doc_id long, piece int, start int, length int, text string, pack_length int"


def word_starts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte that each token of the texts begins at, and how many tokens came before each text."""
    starts, _, counts = K.spans(buf, offsets, K.NOT_SPACE)
    return starts, counts


def tiktoken_starts(path: str, pattern: str) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Tokens of a vocabulary file of ranks, for `starts`. A token that begins inside a character begins with it."""
    held: list = []

    def starts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not held:
            import base64

            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            held.append(tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
        out, counts = [np.zeros(0, np.int64)], [0]
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            tokens = held[0].encode_ordinary(bytes(buf[lo:hi]).decode())
            size = np.array([len(held[0].decode_single_token_bytes(x)) for x in tokens], np.int64)
            at = lo + np.cumsum(np.r_[0, size])[:-1]
            while len(at) and (inside := (buf[at] & 0xC0) == 0x80).any():
                at = at - inside
            out.append(at)
            counts.append(counts[-1] + len(tokens))
        return np.concatenate(out), np.array(counts)

    return starts


def patterns(histogram: dict[int, int], max_len: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of packs, their lengths), shortest pack first."""
    by_room: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(max_len + 1)]
    roomiest = 0
    for length in sorted((x for x in histogram if histogram[x] > 0), reverse=True):
        left = histogram[length]
        while left:
            while roomiest and not by_room[roomiest]:
                roomiest -= 1
            if roomiest < length:  # not even the shortest pack takes it: new ones, each the shortest until it is full
                fits = max_len // length
                full, rest = divmod(left, fits)
                for n, k in ((full, fits), (1, rest)):
                    if n and k:
                        by_room[max_len - k * length].append((n, (length,) * k))
                        roomiest = max(roomiest, max_len - k * length)
                break
            n, pattern = by_room[roomiest].pop()
            take = min(n, left)
            if n > take:
                by_room[roomiest].append((n - take, pattern))
            by_room[roomiest - length].append((take, (*pattern, length)))
            left -= take
    return [x for room in by_room for x in room]


def slots(found: list[tuple[int, tuple[int, ...]]], max_len: int) -> dict[str, np.ndarray]:
    """For each slot: the key of its first text (length, rank), its first pack and its place in the pack; sorted by key."""
    next_rank = np.zeros(max_len + 1, np.int64)
    rows, pack = [], 0
    for n, lengths in found:
        at = 0
        for position, length in enumerate(lengths):
            rows.append((length, next_rank[length], pack, position, at, sum(lengths)))
            next_rank[length] += n
            at += length
        pack += n
    rows.sort()
    names = ("length", "rank", "pack", "position", "offset", "filled")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}


def pieces(docs: DataFrame, max_len: int, starts: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The texts as pieces of at most max_len, numbered within partition and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(max_len + 1, np.int64)
        for batch in batches:
            for b in K.passes(batch):
                buf, offsets = K.buffer(b.column("text"))
                begins, counts = starts(buf, offsets)
                size = np.diff(counts).astype(np.int64)
                n = -(-size // max_len)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(np.r_[0, n])[:-1], n)
                length = np.minimum(max_len, size[row] - piece * max_len)
                order = np.argsort(length, kind="stable")
                run_of = length[order]
                begin = np.searchsorted(run_of, run_of)
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) - begin + seen[run_of]
                seen += np.bincount(length, minlength=max_len + 1)
                ids = b.column("doc_id").take(pa.array(row))
                # A text's first piece begins with the text, its last ends with it.
                first = np.where(piece == 0, offsets[row], begins[np.minimum(counts[row] + piece * max_len, max(len(begins) - 1, 0))] if len(begins) else 0)
                last = np.where(piece == n[row] - 1, offsets[row + 1], np.r_[first[1:], len(buf)]) if len(row) else first
                whole = bytes(buf)
                text = pa.array([whole[x:y] for x, y in zip(first.tolist(), last.tolist(), strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), pa.array(piece * max_len, pa.int32()), pa.array(length, pa.int32()), text, pa.array(np.full(len(row), part), pa.int32()), pa.array(nth)], ["doc_id", "piece", "start", "length", "text", "part", "nth"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, max_len: int = 2048, starts: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] = word_starts) -> DataFrame:
    """One row a piece: its pack, its place in it, which tokens of which document it holds, and their text."""
    cut = store(pieces(docs, max_len, starts), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most max_len rows
    table = slots(patterns(histogram, max_len), max_len)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = cut.join(before.select("part", "length", F.coalesce("before", F.lit(0)).alias("before")), ["part", "length"]).select("doc_id", "piece", "start", "length", "text", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        cuts = np.searchsorted(s["length"], np.arange(max_len + 2))
        for b in batches:
            length, rank = np.asarray(b.column("length")).astype(np.int64), np.asarray(b.column("rank"))
            at = np.empty(len(rank), np.int64)
            for x in np.unique(length).tolist():
                own = length == x
                at[own] = cuts[x] + np.searchsorted(s["rank"][cuts[x] : cuts[x + 1]], rank[own], "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(s["pack"][at] + rank - s["rank"][at]), pa.array(s["position"][at], pa.int32()), b.column("doc_id"), b.column("piece"), b.column("start"), b.column("length"), b.column("text"), pa.array(s["filled"][at], pa.int32())],
                ["pack_id", "position", "doc_id", "piece", "start", "length", "text", "pack_length"],
            )

    return ranked.mapInArrow(place, OUT)
