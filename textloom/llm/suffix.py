"""Repeated passages by suffix arrays built in two stages.

A passage of `window` words (white-space separated; case and punctuation count) is a duplicate where the same
words already stand at an earlier place of the corpus, by (doc_id, word). Result: for each document the
words that duplicates cover. Words are compared by hashes of 32 bits, so two windows that differ in m words
are taken for one with probability 2^(-32 m); but for that the result is exact, as its SQL says.

The suffix array of the whole corpus is never one array. Each window of words is assigned to the least
hash of its k-grams (a minimiser): equal windows have equal minimisers, so neighbouring windows of one
minimiser travel as one stretch of words to the task that owns it, and stretches whose minimiser occurs
once in the corpus never travel. A task sorts the suffixes of its stretches in two stages (Itoh and
Tanaka, 1999): only suffixes smaller than their successors are sorted directly; all others are induced by
one scan over the buckets. Adjacent common prefixes of `window` words or more then mark the repeats.
Suffixes are ordered by their first `window` words, which is all that a prefix of that length needs, so
periodic text costs no more than other text.

A stretch that is equal (by 64 bits) to an earlier one of the same pass over the texts is a duplicate at once, so a
passage that many documents share travels once a pass, not once a document. A minimiser that occurs more
than `heavy` times, as in boilerplate that a third of all documents share, is never gathered: its windows are
aggregated one by one, to the first place of each (64 bits of hash), which combines before it travels.

Defined results: null and empty texts and texts of fewer words than `window` have no duplicates; a row
that repeats both id and text is the same row, not a duplicate of it; equal texts under different ids
repeat each other, the least id stays whole (of one id, the row of the least hash); a null id comes after all others; overlaps within a text
count, so the first period of periodic text stays; a very long text is handled whole, in memory in proportion to
itself; an empty table gives an empty result. Columns other than id and text are not read by `repeats`, and
are kept as they are by `cut`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .frames import fresh, map_keyed, map_passes, row_key, store

LAST_ID = 2**63 - 1
FOUND = "rk long, doc_id long, from int, to int"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n, size = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while size * 2 <= w:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n])


def stretches(texts: pa.Array, window: int, k: int):
    """Word hashes, words before each text, and the stretches: text, first window, windows, minimiser, times that its gram occurs."""
    buf, offsets = K.buffer(texts)
    starts, ends, counts = K.spans(buf, offsets, K.NOT_SPACE)
    h = K.hashes(buf, starts, ends)
    text = K.owners(counts)
    n = len(h) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return h, counts, (none, none, none, none.view(np.uint64), none)
    g = K.rolling(h, k)
    least = sliding_min(g, window - k + 1)
    whole = text[:n] == text[window - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return h, counts, (none, none, none, none.view(np.uint64), none)
    new = np.r_[True, (np.diff(at) > 1) | (least[at[1:]] != least[at[:-1]]) | (text[at[1:]] != text[at[:-1]])]
    first = at[new]
    size = np.diff(np.r_[np.flatnonzero(new), len(at)])
    value = least[first]
    span = size + window - k
    begin = np.cumsum(np.r_[0, span])[:-1]
    place = np.repeat(first - begin, span) + np.arange(int(span.sum()))
    times = np.add.reduceat((g[place] == np.repeat(value, span)).astype(np.int64), begin)
    return h, counts, (text[first], first, size, value, times)


def _anchors(window: int, k: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        _, _, (text, _, _, value, times) = stretches(batch.column("text"), window, k)
        if not len(value):
            return None
        order = np.argsort(value, kind="stable")
        value, rk = value[order], np.asarray(batch.column("rk"))[text[order]]
        new = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        n = np.add.reduceat(times[order], new)
        return pa.RecordBatch.from_arrays([pa.array(value[new].view(np.int64)), pa.array(n), K.lists(rk, np.r_[new, len(rk)])], ["anchor", "n", "rks"])

    return work


def _travel(window: int, k: int):
    """Stretches of repeated minimisers; one that equals an earlier one of the pass goes without its words. Of heavy minimisers (whole is false) each window, named by its hash."""
    names = ["whole", "anchor", "doc_id", "rk", "start", "size", "words"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        h, counts, found = stretches(batch.column("text"), window, k)
        parts = [x for x in (_whole(batch, h, counts, found), _single(batch, h, counts, found)) if x is not None]
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None

    def chosen(batch: pa.RecordBatch, column: str, value: np.ndarray) -> np.ndarray:
        return np.isin(value, np.unique(np.asarray(batch.column(column).flatten()).view(np.uint64)))

    def _single(batch: pa.RecordBatch, h, counts, found) -> pa.RecordBatch | None:
        text, first, size, value, _ = found
        keep = chosen(batch, "heavy", value)
        if not keep.any():
            return None
        text, first, size = text[keep], first[keep], size[keep]
        at = np.repeat(first - np.cumsum(np.r_[0, size])[:-1], size) + np.arange(int(size.sum()))
        of = np.repeat(text, size)
        p, inverse = K._power(len(h) + 1)
        with np.errstate(over="ignore"):
            sums = np.r_[np.uint64(0), np.cumsum(h * p[: len(h)], dtype=np.uint64)]
            name = K.mix((sums[at + window] - sums[at]) * inverse[at])
        ids, rk = np.asarray(pa.compute.fill_null(batch.column("doc_id"), LAST_ID))[of], np.asarray(batch.column("rk"))[of]
        n = len(at)
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, bool)), pa.array(name.view(np.int64)), pa.array(ids), pa.array(rk), pa.array(at - counts[of], pa.int32()), pa.array(np.ones(n), pa.int32()), pa.nulls(n, pa.binary())], names)

    def _whole(batch: pa.RecordBatch, h, counts, found) -> pa.RecordBatch | None:
        text, first, size, value, _ = found
        keep = chosen(batch, "anchors", value)
        text, first, size, value = text[keep], first[keep], size[keep], value[keep]
        if not len(value):
            return None
        ids, rk = np.asarray(pa.compute.fill_null(batch.column("doc_id"), LAST_ID))[text], np.asarray(batch.column("rk"))[text]
        start = first - counts[text]
        words = (h >> np.uint64(32)).astype(np.uint32)
        p, inverse = K._power(len(h) + 1)
        with np.errstate(over="ignore"):
            sums = np.r_[np.uint64(0), np.cumsum(h * p[: len(h)], dtype=np.uint64)]
            same = K.mix((sums[first + size + window - 1] - sums[first]) * inverse[first] + size.astype(np.uint64))
        order = np.lexsort((start, rk, ids, same))
        again = np.r_[False, same[order][1:] == same[order][:-1]]
        lead = order[np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))]
        itself = (rk[order] == rk[lead]) & (start[order] == start[lead])
        drop = again & itself
        order, again = order[~drop], again[~drop]
        raw = [None if a else words[f : f + s + window - 1].tobytes() for a, f, s in zip(again.tolist(), first[order].tolist(), size[order].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(order), bool)), pa.array(value[order].view(np.int64)), pa.array(ids[order]), pa.array(rk[order]), pa.array(start[order], pa.int32()), pa.array(size[order], pa.int32()), pa.array(raw, pa.binary())], names)

    return work


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of t ordered by their first `depth` symbols or more, in two stages."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    t = t.astype(np.int64)
    step = np.sign(np.diff(np.r_[t, -1]))  # the end is smaller than any symbol
    runs = np.where(step != 0, np.arange(n), n)
    after = np.minimum.accumulate(runs[::-1])[::-1]
    smaller = step[after] > 0  # than its successor: sorted directly
    # Stage one: sort by as many symbols at once as fit 63 bits; only ties go on.
    padded = np.r_[t + 1, np.zeros(depth + 64, np.int64)]
    bits = max(1, int(padded.max()).bit_length())
    per = max(1, 63 // bits)
    pos = np.flatnonzero(smaller)

    def key(at: np.ndarray, d: int) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for i in range(per):
            out = (out << bits) | padded[at + (d + i)]
        return out

    if len(pos):
        x = key(pos, 0)
        order = np.argsort(x, kind="stable")
        pos, x = pos[order], x[order]
        group = np.cumsum(np.r_[0, x[1:] != x[:-1]])
        d = per
        while d < depth:
            size = np.bincount(group)
            open_ = np.flatnonzero(size[group] > 1)
            if not len(open_):
                break
            x = key(pos[open_], d)
            order = np.lexsort((x, group[open_]))
            pos[open_] = pos[open_][order]
            x, g = x[order], group[open_]
            cut = np.zeros(len(group), np.int64)
            cut[open_[1:]] = (x[1:] != x[:-1]) & (g[1:] == g[:-1])
            group = group + np.cumsum(cut)
            d += per
    # Stage two: scan the buckets from the least; a suffix puts its larger predecessor at its bucket's head.
    count = np.bincount(t)
    head = np.cumsum(np.r_[0, count])[:-1]
    sa = np.full(n, -1, np.int64)
    if len(pos):
        symbol = t[pos]
        begin = np.searchsorted(symbol, symbol)
        n_small = np.bincount(symbol, minlength=len(count))
        sa[head[symbol] + count[symbol] - n_small[symbol] + np.arange(len(pos)) - begin] = pos
    out, heads, symbols, is_small = sa.tolist(), head.tolist(), t.tolist(), smaller.tolist()
    if not is_small[n - 1]:
        c = symbols[n - 1]
        out[heads[c]] = n - 1
        heads[c] += 1
    for s in out:
        j = s - 1
        if j >= 0 and not is_small[j]:
            c = symbols[j]
            out[heads[c]] = j
            heads[c] += 1
    return np.array(out, np.int64)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, up to `most` symbols."""
    n = len(t)
    codes = K.mix(t.astype(np.uint64))
    p, inverse = K._power(n + 1)
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(codes * p[:n], dtype=np.uint64)]
        a, b = sa[:-1], sa[1:]
        room = np.minimum(n - np.maximum(a, b), most)
        low = np.zeros(len(a), np.int64)
        step = 1 << max(0, int(most).bit_length())
        while step:
            to = low + step
            ok = to <= room
            to = np.where(ok, to, low)
            same = ok & ((sums[a + to] - sums[a]) * inverse[a] == (sums[b + to] - sums[b]) * inverse[b])
            low = np.where(same, to, low)
            step >>= 1
    return np.r_[0, low]


def _sort(window: int):
    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, rk = rows.column("doc_id").to_numpy(), rows.column("rk").to_numpy()
        start, size = rows.column("start").to_numpy().astype(np.int64), rows.column("size").to_numpy().astype(np.int64)
        words = rows.column("words").to_pylist()
        out_rk, out_id, out_from, out_to = [], [], [], []

        def say(at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
            out_rk.append(rk[at]), out_id.append(ids[at]), out_from.append(begin), out_to.append(end)

        told = np.array([i for i, w in enumerate(words) if w is None], np.int64)
        say(told, start[told], start[told] + size[told])
        order = np.array([i for i, w in enumerate(words) if w is not None], np.int64)
        order = order[np.lexsort((start[order], rk[order], ids[order]))]
        lead: dict[bytes, int] = {}
        again = []
        for i in order.tolist():
            j = lead.setdefault(words[i], i)
            if j != i and (rk[i] != rk[j] or start[i] != start[j]):
                again.append(i)
        again = np.array(again, np.int64)
        say(again, start[again], start[again] + size[again])
        own = np.array(list(lead.values()), np.int64)  # in the order of the corpus
        if len(own):
            parts = [np.frombuffer(words[i], np.uint32) for i in own.tolist()]
            n = np.array([len(x) for x in parts])
            m = len(parts)
            codes = np.unique(np.concatenate(parts), return_inverse=True)[1] + m
            begin = np.cumsum(np.r_[0, n + 1])[:-1]
            t = np.empty(int((n + 1).sum()), np.int64)
            t[begin + n] = np.arange(m)  # every stretch ends in a symbol of its own, less than all words
            of = np.repeat(np.arange(m), n)
            t[np.arange(len(codes)) + of] = codes
            sa = suffix_array(t, window)
            lcp = common_prefixes(t, sa, window)
            linked = lcp >= window
            if linked.any():
                run = np.cumsum(~linked)
                inside = linked | np.r_[linked[1:], False]
                at, run = sa[inside], run[inside]
                stretch = np.searchsorted(begin, at, "right") - 1
                place = at - begin[stretch]
                # Stretches are in the order of the corpus, but overlap within a text.
                where = start[own[stretch]] + place
                order = np.lexsort((where, rk[own[stretch]], ids[own[stretch]], run))
                run, stretch, where = run[order], stretch[order], where[order]
                later = np.r_[False, run[1:] == run[:-1]]
                first = np.maximum.accumulate(np.where(later, 0, np.arange(len(run))))
                later &= (where != where[first]) | (rk[own[stretch]] != rk[own[stretch[first]]])
                say(own[stretch[later]], where[later], where[later] + 1)
        a, b, c, d = (np.concatenate(x) for x in (out_rk, out_id, out_from, out_to))
        if len(a):
            order = np.lexsort((c, a))
            a, b, c, d = a[order], b[order], c[order], d[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (c[1:] > d[:-1])]  # only direct neighbours; overlaps are joined later
            head = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(a[head]), pa.array(b[head]), pa.array(c[head], pa.int32()), pa.array(np.maximum.reduceat(d, head), pa.int32())], ["rk", "doc_id", "from", "to"])

    return work


def _join(window: int):
    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rk, ids = rows.column("rk").to_numpy(), rows.column("doc_id").to_numpy()
        a, b = rows.column("from").to_numpy().astype(np.int64), rows.column("to").to_numpy().astype(np.int64) + window - 1
        order = np.lexsort((a, rk))
        rk, ids, a, b = rk[order], ids[order], a[order], b[order]
        # Running end within the row: rows are told apart by an offset larger than any place.
        base = np.cumsum(np.r_[0, rk[1:] != rk[:-1]]) * (int(b.max()) + 2)
        end = np.maximum.accumulate(b + base)
        new = np.r_[True, (a + base)[1:] > end[:-1]]
        head = np.flatnonzero(new)
        last = np.r_[head[1:], len(a)] - 1
        doc = pa.array(ids[head], mask=ids[head] == LAST_ID)
        yield pa.RecordBatch.from_arrays([pa.array(rk[head]), doc, pa.array(a[head], pa.int32()), pa.array((end - base)[last], pa.int32())], ["rk", "doc_id", "start", "end"])

    return work


def spans_of(docs: DataFrame, window: int = 50, k: int = 10, heavy: int = 200_000) -> DataFrame:
    """rk, doc_id, start, end: the words [start, end) of the row that duplicates cover."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").withColumn("rk", row_key())
    seen = store(map_passes(rows.select("rk", "text"), _anchors(window, k), "anchor long, n long, rks array<long>"), "anchors")
    counts = seen.groupBy("anchor").agg(F.sum("n").alias("times")).where("times > 1")
    some = seen.select("anchor", "rks").join(counts, "anchor").select("anchor", (F.col("times") > heavy).alias("is_heavy"), F.explode("rks").alias("rk"))
    pick = lambda c: F.collect_set(F.when(c, F.col("anchor")))  # noqa: E731 - nulls are left out
    wanted = some.groupBy("rk").agg(pick(~F.col("is_heavy")).alias("anchors"), pick(F.col("is_heavy")).alias("heavy"))
    ready = map_passes(rows.join(wanted, "rk"), _travel(window, k), "whole boolean, anchor long, doc_id long, rk long, start int, size int, words binary")
    if counts.where(F.col("times") > heavy).isEmpty():
        found = map_keyed(ready.drop("whole"), "anchor", _sort(window), FOUND, least=8_000)
    else:
        ready = store(ready, "stretches")
        single = ready.where("not whole").select("anchor", F.struct("doc_id", "rk", "start").alias("place"))
        first = single.groupBy("anchor").agg(F.min("place").alias("first"))
        told = single.join(first, "anchor").where("place <> first").select("place.rk", "place.doc_id", F.col("place.start").alias("from"), (F.col("place.start") + 1).alias("to"))
        found = map_keyed(ready.where("whole").drop("whole"), "anchor", _sort(window), FOUND, least=8_000).unionByName(told)
    return map_keyed(found, "rk", _join(window), "rk long, doc_id long, start int, end int", least=50_000)


def repeats(docs: DataFrame, window: int = 50, k: int = 10, heavy: int = 200_000) -> DataFrame:
    """One row a run of duplicate words: doc_id, start, end (in words)."""
    return spans_of(docs, window, k, heavy).select("doc_id", "start", "end")


def oracle(window: int = 50) -> str:
    """DuckDB, for tables in which no id repeats: every window as text, its later places, and the runs that they cover."""
    return f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\\x09-\\x0d\\x1c-\\x20]+'), lambda x: x <> '') w FROM documents),
x AS (SELECT doc_id, unnest(w) word, generate_subscripts(w, 1) - 1 i FROM w),
k AS (SELECT doc_id, i, md5(string_agg(word, ' ') OVER v) h, count(*) OVER v n FROM x WINDOW v AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING)),
d AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) r FROM k WHERE n = {window}),
c AS (SELECT doc_id, i s, i + {window} e, max(i + {window}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before FROM d WHERE r > 1),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) part FROM c)
SELECT doc_id, min(s)::INT AS start, max(e)::INT AS "end" FROM g GROUP BY doc_id, part"""


def cut(docs: DataFrame, window: int = 50, k: int = 10) -> DataFrame:
    """The documents, all columns, without the words that duplicates cover; n_chars, where there is one, follows the text."""
    # The id is in the key as well as in the hash: two rows of one id and one hash are one row.
    id_, rk, spans = fresh(docs.columns, "_tl_id", "_tl_rk", "_tl_spans")
    found = spans_of(docs, window, k).groupBy(F.coalesce("doc_id", F.lit(LAST_ID)).alias(id_), F.col("rk").alias(rk)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(spans))
    own = F.col("doc_id").cast("long")
    joined = docs.withColumn(id_, F.coalesce(own, F.lit(LAST_ID))).withColumn(rk, F.xxhash64(own, F.col("text"))).join(found, [id_, rk], "left")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in K.passes(whole):
                keep = b.column(spans).is_null().to_numpy(zero_copy_only=False)
                texts = b.column("text")
                if not keep.all():
                    hit = np.flatnonzero(~keep)
                    some = texts.take(pa.array(hit))
                    buf, offsets = K.buffer(some)
                    starts, ends, counts = K.spans(buf, offsets, K.NOT_SPACE)
                    new = texts.to_pylist()
                    listed = b.column(spans).take(pa.array(hit)).to_pylist()
                    for i, row in enumerate(hit.tolist()):
                        out, at = [], int(offsets[i])
                        for s in listed[i]:
                            out.append(bytes(buf[at : starts[counts[i] + s["start"]]]))
                            last = counts[i] + s["end"]
                            at = int(starts[last]) if last < counts[i + 1] else int(offsets[i + 1])
                        out.append(bytes(buf[at : offsets[i + 1]]))
                        new[row] = b"".join(out).decode()
                    texts = pa.array(new, pa.string())
                columns = {x: b.column(x) for x in names} | {"text": texts}
                if "n_chars" in columns:
                    old = columns["n_chars"]
                    length = pa.compute.if_else(pa.array(keep), old, pa.compute.utf8_length(texts).cast(old.type))
                    columns["n_chars"] = length
                yield pa.RecordBatch.from_arrays([columns[x] for x in names], names)

    return joined.mapInArrow(run, docs.schema)
