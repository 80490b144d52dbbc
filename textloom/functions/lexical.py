"""Lexical overlap of texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_tokens
from .vector import jaccard


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Numbers of the strands of pairs that are combed together, about.
TOGETHER = 1 << 18


def semilocal_ends(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each pair (a, b), and each place i of b, the place where the strand that enters there leaves below, or len(b) if it leaves at the side.

    The strands of the sticky braid of a and b (Tiskin, 2008) are combed an anti-diagonal at a time: two
    that meet cross unless they have crossed before or the symbols match. The longest common subsequence
    of a with b[i:j] is then j - i less the strands that enter at i or later and leave before j, for all
    i and j at once. All pairs are combed together, the shorter ones with symbols at their ends that match none.
    """
    k, m, n = len(pairs), max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    symbols, place = np.unique(np.concatenate([x for p in pairs for x in p]), return_inverse=True)
    small = np.uint16 if len(symbols) < 65_000 else np.uint32
    place = np.split((place.ravel() + 2).astype(small), np.cumsum([len(x) for p in pairs for x in p])[:-1])
    back, across = np.zeros((m, k), small), np.ones((n, k), small)
    for i in range(k):
        back[m - len(place[2 * i]) :, i] = place[2 * i][::-1]
        across[: len(place[2 * i + 1]), i] = place[2 * i + 1]
    number = np.int16 if m + n < 32_000 else np.int32
    side, top = (np.repeat(np.arange(*ends, dtype=number)[:, None], k, 1) for ends in ((0, m), (m, m + n)))
    for d in range(m + n - 1):
        i0, i1 = max(0, d - n + 1), min(m - 1, d)  # rows of the anti-diagonal
        h = slice(m - 1 - i1, m - i0)
        v = slice(d - i1, d - i0 + 1)
        x, y = side[h], top[v]
        least = np.minimum(x, y)
        match = -(back[h] == across[v]).astype(number)  # all bits of a match are set
        both = x + y
        least ^= (least ^ y) & match  # y where the symbols match, else the lesser
        side[h] = least
        both -= least
        top[v] = both
    ends = np.full((n, k), n, np.int64)
    at, pair = np.nonzero(top >= m)
    ends[top[at, pair].astype(np.int64) - m, pair] = at
    return [np.minimum(ends[: len(b), i], len(b)) for i, (_, b) in enumerate(pairs)]


def _best_window(m: int, ends: np.ndarray) -> float:
    """The best of 200 * common / both lengths over all windows of the length m, those that overhang the ends of the longer text included."""
    n = len(ends)
    below = np.flatnonzero(ends < n)
    starts = np.full(n, -1, np.int64)
    starts[ends[below]] = below
    inside = ends < n
    edge = np.arange(1, min(m, n + 1))
    # Windows cut off at the left end: b[0:j].
    left = edge - np.cumsum(starts >= 0)[edge - 1]
    # Windows cut off at the right end: b[n - j:n].
    right = edge - np.cumsum(inside[::-1])[edge - 1]
    best = max([0.0, *(200.0 * (x / (m + edge)).max() for x in (left, right) if len(edge))])
    if n >= m:
        i = np.arange(n - m)
        first = np.count_nonzero(ends < m)
        missing = first + np.cumsum(np.r_[0, (starts[i + m] > i).astype(np.int64) - (ends[i] < i + m)])
        best = max(best, 200.0 * (m - missing.min()) / (2 * m))
    return float(best)


def partial_ratios(pairs: list[tuple[str, str]]) -> list[float]:
    """For each pair the best ratio of the shorter text with any window of the longer, windows that overhang its ends included; of texts of one length, either way. 0 if either is empty.

    Work is the product of the lengths, memory their sum. Pairs that repeat are compared once; pairs of
    like lengths are compared together.
    """
    best: dict[tuple[str, str], float] = {}
    todo: list[tuple[tuple[str, str], np.ndarray, np.ndarray]] = []
    for pair in dict.fromkeys(pairs):
        short, long_ = sorted(pair, key=len)
        best[pair] = 0.0 if not short or short not in long_ else 100.0
        if short and not best[pair]:
            x, y = _codes(short), _codes(long_)
            todo += [(pair, x, y)] + [(pair, y, x)] * (len(x) == len(y))
    todo.sort(key=lambda z: (len(z[1]) + len(z[2]), len(z[1])))
    at = 0
    while at < len(todo):
        to = at + 1
        while to < len(todo) and (to + 1 - at) * (len(todo[to][1]) + len(todo[to][2])) <= TOGETHER and len(todo[to][1]) + len(todo[to][2]) <= 1.2 * (len(todo[at][1]) + len(todo[at][2])):
            to += 1
        for (pair, x, _), ends in zip(todo[at:to], semilocal_ends([z[1:] for z in todo[at:to]]), strict=True):
            best[pair] = max(best[pair], _best_window(len(x), ends))
        at = to
    return [best[p] for p in pairs]


def partial_ratio(a: str, b: str) -> float:
    return partial_ratios([(a, b)])[0]


def _partial(a: pd.Series, b: pd.Series) -> pd.Series:
    known = [(x, y) for x, y in zip(a, b, strict=True) if x is not None and y is not None]
    found = iter(partial_ratios(known))
    return pd.Series([next(found) / 100 if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


def syntactic_similarity(a: Column, b: Column, method: str = "partial_ratio") -> Column:
    """0 to 1. Of the sorted distinct tokens as text (partial_ratio) or as sets (jaccard); two texts without tokens have 0."""
    x, y = (F.array_sort(F.array_distinct(normalize_tokens(c))) for c in (a, b))
    if method == "jaccard":
        return jaccard(x, y)
    if method != "partial_ratio":
        raise ValueError(f"unknown method {method}")
    return F.pandas_udf(_partial, "double")(F.array_join(x, " "), F.array_join(y, " "))
