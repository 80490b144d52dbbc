"""Sampled segmentation into SentencePiece pieces, and lossless decoding.

The lattice of a text has an edge for every piece that matches at a position. A segmentation is drawn
from P(s) ~ prod p(piece)^alpha by forward filtering, which sums the weight of all ways to reach each
position, and backward sampling, which walks from the end and takes each incoming edge in proportion.
Draws come from a counter: (row key, word, step) decides each, so a row's segmentation is the same in any
batch, partition or run, and another `seed` gives another.

No piece of such a vocabulary crosses from a character to a following space, and none holds a line
break, so a text's lattice is a chain of the lattices of its words: each distinct word's forward sums are
made once a pass, and all words of the pass are walked back together, an edge at a time.

The vocabulary is a public SentencePiece file, read on the driver and sent to the tasks (its size is
fixed). A BPE file ranks its pieces and has no probabilities; they are taken to fall as 1 / rank (Zipf's
law). A character without a piece is spelled in byte pieces.

Encoding puts one space in front, as these vocabularies expect, and decoding takes it away; spaces are
written U+2581, and a U+2581 of the text itself is spelled in bytes, so decode(encode(x)) == x for every
text. Defined results: null gives null, empty text no pieces; rows that repeat an id and text get the same
pieces; a null id counts as id 0; segmentations that tie are drawn between; a very long text is a pass of its own, in
memory in proportion to itself; an empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
PASS = 4 << 20
SPACE = "▁"
OUT = "doc_id long, pieces array<int>, n int, lossless boolean"


@dataclass
class Vocabulary:
    bytes_: np.ndarray  # the bytes that each id decodes to, one after the other; spaces as spaces
    begin: np.ndarray
    log_p: np.ndarray
    keys: np.ndarray  # trie edges: slot -> parent * 256 + byte, by open addressing
    child: np.ndarray
    bits: int
    piece_at: np.ndarray  # node -> id, or -1
    byte_id: np.ndarray


def vocabulary(path: str = PIECES) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    text, log_p, byte_id = [b""] * n, np.full(n, -np.inf), np.full(256, -1, np.int64)
    usable, scores = [], np.array([m.get_score(i) for i in range(n)])
    for i in range(n):
        if m.is_byte(i):
            byte_id[int(m.id_to_piece(i)[3:5], 16)] = i
            text[i] = bytes([int(m.id_to_piece(i)[3:5], 16)])
        elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
            text[i] = m.id_to_piece(i).replace(SPACE, " ").encode()
            usable.append(i)
    if (byte_id < 0).any():
        raise ValueError("the vocabulary needs a piece for every byte")
    if any(b" " in text[i].lstrip(b" ") or b"\n" in text[i] for i in usable):
        raise ValueError("a piece of the vocabulary crosses words")
    order = sorted(usable, key=lambda i: -scores[i])
    unigram = scores[usable].max() <= 0 and scores[usable].min() > -100
    ranks = np.empty(n)
    ranks[order] = np.arange(1, len(order) + 1)
    log_p[usable] = scores[usable] if unigram else -np.log(ranks[usable]) - np.log(np.log(len(order)) + 0.5772)
    log_p[byte_id] = log_p[usable].min()
    edges: dict[int, int] = {}
    piece_at = [-1]
    for i in usable:
        node = 0
        for b in text[i]:
            node = edges.setdefault(node * 256 + b, len(piece_at))
            if node == len(piece_at):
                piece_at.append(-1)
        piece_at[node] = i
    bits = max(8, (len(edges) * 4).bit_length())
    keys, child = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
    for key, to in edges.items():
        slot = _slot(key, bits)
        while keys[slot] >= 0:
            slot = (slot + 1) & ((1 << bits) - 1)
        keys[slot], child[slot] = key, to
    flat = b"".join(text)
    return Vocabulary(np.frombuffer(flat, np.uint8), np.cumsum([0, *map(len, text)]), log_p, keys, child, bits, np.array(piece_at, np.int32), byte_id)


def _slot(key, bits: int):
    if isinstance(key, int):
        return ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - bits)
    with np.errstate(over="ignore"):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _step(v: Vocabulary, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The node that follows, or -1."""
    key = node.astype(np.int64) * 256 + byte
    slot = _slot(key, v.bits)
    found = v.keys[slot]
    out = np.where(found == key, v.child[slot], -1)
    open_ = np.flatnonzero((found != key) & (found >= 0))
    while len(open_):
        slot[open_] = (slot[open_] + 1) & ((1 << v.bits) - 1)
        found = v.keys[slot[open_]]
        hit = found == key[open_]
        out[open_[hit]] = v.child[slot[open_[hit]]]
        open_ = open_[~hit & (found >= 0)]
    return out


def lattice(v: Vocabulary, flat: np.ndarray, begin: np.ndarray, alpha: float):
    """Of words laid end to end: for each incoming edge by its end, where it starts, its piece, and the cumulative share of the weight of its end.

    Positions count within all words, each of which has one position more than bytes. Returns (first edge
    of each position, start, piece, share).
    """
    n = len(begin) - 1
    size = np.diff(begin)
    word = np.repeat(np.arange(n), size)
    place = np.arange(len(flat)) + word  # position before each byte
    left = begin[word + 1] - np.arange(len(flat))  # bytes to the word's end
    starts, ends, found = [], [], []
    at, node, length = np.arange(len(flat)), np.zeros(len(flat), np.int32), 0
    single = np.zeros(len(flat), bool)
    lead = (flat & 0xC0) != 0x80
    width = np.where(flat < 0x80, 1, np.where(flat < 0xE0, 2, np.where(flat < 0xF0, 3, 4)))
    at = at[lead]
    node = node[lead]
    while len(at):
        node = _step(v, node, flat[at + length])
        ok = node >= 0
        at, node = at[ok], node[ok]
        length += 1
        piece = v.piece_at[node]
        hit = np.flatnonzero(piece >= 0)
        starts.append(place[at[hit]])
        ends.append(place[at[hit]] + length)
        found.append(piece[hit])
        single[at[hit[width[at[hit]] == length]]] = True
        more = left[at] > length
        at, node = at[more], node[more]
    # U+2581 itself would decode to a space.
    # Characters without a piece: an edge for each byte.
    bare = np.flatnonzero(lead & ~single)
    for i in range(4):
        own = bare[width[bare] > i] + i
        starts.append(place[own])
        ends.append(place[own] + 1)
        found.append(v.byte_id[flat[own]].astype(np.int32))
    start, end, piece = (np.concatenate(x).astype(np.int64) for x in (starts, ends, found))
    # Forward filtering, by the distance of the end from the word's start.
    first = begin[:-1] + np.arange(n)
    home = first[np.searchsorted(first, start, "right") - 1]
    far = end - home
    order = np.lexsort((end, far))
    start, end, piece, far = start[order], end[order], piece[order], far[order]
    weight = alpha * v.log_p[piece]
    log_f = np.full(len(flat) + n, -np.inf)
    log_f[first] = 0
    share = np.empty(len(start))
    cuts = np.flatnonzero(np.r_[True, far[1:] != far[:-1], True]) if len(far) else np.zeros(1, np.int64)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        e = end[lo:hi]
        new = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
        x = log_f[start[lo:hi]] + weight[lo:hi]
        top = np.maximum.reduceat(x, new)
        reps = np.diff(np.r_[new, hi - lo])
        top = np.where(np.isfinite(top), top, 0.0)
        x = np.exp(x - np.repeat(top, reps))
        total = np.add.reduceat(x, new)
        run = np.cumsum(x)
        run -= np.repeat(run[new] - x[new], reps)
        with np.errstate(divide="ignore", invalid="ignore"):
            share[lo:hi] = run / np.repeat(total, reps)
            log_f[e[new]] = top + np.log(total)
    order = np.argsort(end, kind="stable")
    start, piece, share, end = start[order], piece[order], share[order], end[order]
    return np.searchsorted(end, np.arange(len(flat) + n + 1)), start, piece.astype(np.int32), share


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut where a space follows a character that is none, and around line breaks: start, end, words before each text."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space, line = buf == 32, buf == 10
    cut = np.zeros(n, bool)
    cut[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    cut[firsts] = True
    starts = np.flatnonzero(cut)
    return starts, np.r_[starts[1:], n], np.searchsorted(starts, offsets)


def encode(v: Vocabulary, texts: pa.Array, keys: np.ndarray, alpha: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all texts, flat, and each text's first (one more at the end)."""
    raw, off = K.buffer(texts)
    size = np.diff(off)
    has = size > 0
    offsets = np.cumsum(np.r_[0, size + has])
    buf = np.full(int(offsets[-1]), 32, np.uint8)
    text = np.repeat(np.arange(len(size)), size)
    buf[np.arange(len(raw)) + np.cumsum(has)[text]] = raw
    starts, ends, counts = words(buf, offsets)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(size) + 1, np.int64)
    h = K.hashes(buf, starts, ends)
    order = np.argsort(h, kind="stable")
    new = np.r_[True, h[order][1:] != h[order][:-1]]
    lead = order[new]
    n = (ends - starts)[lead]
    begin = np.cumsum(np.r_[0, n])
    flat = buf[np.repeat(starts[lead] - begin[:-1], n) + np.arange(int(begin[-1]))]
    first_edge, edge_start, edge_piece, share = lattice(v, flat, begin, alpha)
    # Backward sampling of all words together, in the order of their distinct forms.
    form = np.cumsum(new) - 1
    home = begin[:-1][form] + form
    at = home + n[form]
    row = K.owners(counts)
    with np.errstate(over="ignore"):
        counter = K.mix(K.mix(keys + np.uint64(seed))[row] + (np.arange(len(row)) - counts[row]).astype(np.uint64))[order]
    live = np.arange(len(order))
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    made = np.zeros(len(order), np.int32)
    step = 0
    while len(live):
        lo = first_edge[at]
        with np.errstate(over="ignore"):
            u = (((counter + np.uint64(step * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)) ^ counter) >> np.uint64(11)
        u = K.mix(u).astype(np.float64) * 2.0**-64
        ask = np.arange(len(lo))
        edge = lo
        while len(ask):  # on to the first edge whose cumulative share reaches u
            ask = ask[share[edge[ask]] < u[ask]]
            last = first_edge[at[ask] + 1] - 1
            ask = ask[edge[ask] < last]
            edge[ask] += 1
        steps.append((live, edge_piece[edge]))
        made[live] += 1
        at = edge_start[edge]
        go = at > home
        live, at, home, counter = live[go], at[go], home[go], counter[go]
        step += 1
    tokens = np.empty(len(order), np.int32)
    tokens[order] = made
    base = np.cumsum(np.r_[0, tokens])
    where = base[order] + made - 1
    out = np.empty(int(base[-1]), np.int32)
    for s, (own, piece) in enumerate(steps):
        out[where[own] - s] = piece
    return out, base[counts]


def decode(v: Vocabulary, pieces: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, flat, and each text's first (one more at the end); the space in front is gone."""
    size = np.diff(v.begin)[pieces]
    end = np.cumsum(np.r_[0, size])
    flat = v.bytes_[np.repeat(v.begin[pieces] - end[:-1], size) + np.arange(int(end[-1]))]
    offsets = end[at]
    keep = np.ones(len(flat), bool)
    has = np.diff(offsets) > 0
    keep[offsets[:-1][has]] = False
    return flat[keep], offsets - np.cumsum(np.r_[0, has])


def encode_texts(docs: DataFrame, path: str = PIECES, alpha: float = 0.5, seed: int = 0) -> DataFrame:
    """One row a document: its sampled pieces, and whether they decode to the very text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for b in K.passes(batch, limit=PASS):
                ids, texts = b.column("doc_id"), b.column("text")
                keys = np.asarray(pa.compute.fill_null(ids, 0)).astype(np.int64).view(np.uint64)
                pieces, at = encode(v, texts, keys, alpha, seed)
                raw, off = K.buffer(texts)
                back, back_off = decode(v, pieces, at)
                same = np.diff(back_off) == np.diff(off)
                if len(back) == len(raw):
                    wrong = np.flatnonzero(back != raw)
                    same[np.searchsorted(off, wrong, "right") - 1] = False
                null = texts.is_null().to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(np.asarray(at), pa.int32(), mask=np.r_[null, False]), pa.array(pieces))
                yield pa.RecordBatch.from_arrays([ids, lists, pa.array(np.diff(at), pa.int32(), mask=null), pa.array(same, mask=null)], ["doc_id", "pieces", "n", "lossless"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


def decode_texts(encoded: DataFrame, path: str = PIECES) -> DataFrame:
    """doc_id, text: the inverse of encode_texts."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            lists = b.column("pieces")
            null = lists.is_null().to_numpy(zero_copy_only=False)
            at = np.cumsum(np.r_[0, np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))])
            flat, off = decode(v, np.asarray(lists.flatten()), at)
            data = flat.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if x else data[i:j].decode() for x, i, j in zip(null.tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(run, "doc_id long, text string")
