"""Array kernels over whole Arrow batches of text.

The operators of this package never loop over words in Python. A batch's texts are one buffer of
UTF-8 bytes; words are runs of bytes of a class, found and hashed for the whole buffer at once.
Batches are cut by bytes, not by rows, so one very long text costs memory in proportion to itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one pass of the kernels holds; a longer single text is one pass by itself.
PASS_BYTES = 4 << 20
#: Bytes that `hashes` works on at once.
HASH_BYTES = 1 << 20

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_tables = np.random.Generator(np.random.PCG64(0x5EED)).integers(0, 2**64, 256, dtype=np.uint64) | _U(1)

#: Letters, digits and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Everything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32, 28, 29, 30, 31]] = False

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_powers.get("p", ())):
        size = max(n, HASH_BYTES + 1)
        with np.errstate(over="ignore"):
            _powers["p"] = np.cumprod(np.concatenate([[_U(1)], np.full(size, _P, np.uint64)]), dtype=np.uint64)
            _powers["i"] = np.cumprod(np.concatenate([[_U(1)], np.full(size, _P_INVERSE, np.uint64)]), dtype=np.uint64)
    return _powers["p"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) decided by 64-bit keys."""
    return ((mix(x) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def passes(batch: pa.RecordBatch, column: str = "text", limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch with at most `limit` bytes of text each, or one row."""
    if not batch.num_rows:
        return
    n = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    ends, at = np.cumsum(n, dtype=np.int64), 0
    while at < len(n):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))
        to = max(at + 1, to)
        yield batch.slice(at, to - at)
        at = to


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one more at the end). Nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(buf: np.ndarray, offsets: np.ndarray, of: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and how many words came before each text (one more at the end)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = of[buf]
    edge = np.diff(inside)
    first, last = edge[:-1] == 1, edge[1:] == -1
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]  # a word never runs on into the next text
    cuts = cuts[(inside[cuts + 1] == 1) & (inside[cuts] == 1)]
    first[cuts] = True
    last[cuts - 1] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, equal for equal bytes in any batch. Spans are in order and don't overlap.

    Works through the buffer a stretch of HASH_BYTES at a time, as the arrays in between have eight bytes a byte.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + HASH_BYTES, "right")))
        some = buf[base : int(ends[to - 1])]
        s, e = starts[at:to] - base, ends[at:to] - base
        p, inverse = _power(len(some))
        with np.errstate(over="ignore"):
            sums = np.empty(len(some) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_tables[some] * p[: len(some)], out=sums[1:])
            out[at:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = to
    return out


def hash_strings(words: list[str]) -> np.ndarray:
    """The hash that `hashes` gives to each of these words."""
    buf, offsets = buffer(pa.array(words, pa.string()))
    return hashes(buf, offsets[:-1], offsets[1:])


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k neighbours; shorter by k - 1 (or empty)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * _U(_P) + h[i : i + n]
        return mix(out)


def owners(counts: np.ndarray) -> np.ndarray:
    """The index of the text that each word belongs to, from how many words came before each text."""
    return np.repeat(np.arange(len(counts) - 1), np.diff(counts))


def grams(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-grams within each text, and the text of each.

    A text of 1 to k - 1 words has one gram, all of it, so no text with a word lacks a gram.
    """
    text = owners(counts)
    g = rolling(h, k)
    keep = text[: len(g)] == text[k - 1 :] if len(g) else np.zeros(0, bool)
    size = np.diff(counts)
    small = np.flatnonzero((size > 0) & (size < k))
    if not len(small):
        return g[keep], text[: len(g)][keep]
    extra = np.zeros(len(small), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k - 1):
            has = size[small] > i
            extra[has] = extra[has] * _U(_P) + h[counts[small[has]] + i]
        extra = mix(extra + _U(0xABCDEF))
    all_g, all_t = np.concatenate([g[keep], extra]), np.concatenate([text[: len(g)][keep], small])
    order = np.argsort(all_t, kind="stable")
    return all_g[order], all_t[order]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list column out of flat values and the offset of each row's first."""
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(values, kind))
