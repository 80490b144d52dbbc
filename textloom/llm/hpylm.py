"""Perplexity of documents under a hierarchical Pitman-Yor language model of the corpus.

Every context word has a restaurant; all of them share one parent restaurant, of words, whose base is
uniform (Teh, 2006). A token is a customer of its context's restaurant; the customers of a table eat one
word; each table of a context is a customer of the parent. Seating is sampled by Gibbs: a customer is
taken out and seated again, at a table of its word in proportion to its size less the discount, or at a
new one in proportion to (strength + discount * tables of the context) * parent's probability.

A token's probability is the mass of these choices while it is out, so no token predicts itself: where it
sits alone, its table is out of the parent too, and the parent's table that only this one sits at. It is
averaged over the sweeps after burn-in. A document's perplexity is exp(- mean log averaged probability).

Distribution. Tokens are dealt by a hash of (context, word), so every (context, word) pair is whole in one
bucket and frequent contexts spread over all of them. What crosses buckets, for each word, is the number
of tables that serve it, and of customers and tables in its restaurant as a context: each bucket sends
its counts to the parts of the parent, hashed by word, which add them up, seat the parent's customers by
Gibbs, and send back only the words that a bucket has. Nothing of the size of the vocabulary is ever
broadcast or collected. Each refresh of the parent repeats this with the tables of the last seating, which is
one chain: a bucket goes on from the seating that it ended with, so of the totals of a context what isn't its own is
exactly the other buckets'. Within a refresh the parent's state and other buckets' tables stand still, and a
sweep takes out an eighth of the customers of each pair at once (approximate distributed Gibbs, after Newman et
al., 2009). Pairs of up to eight customers are thus seated one customer at a time; pairs seen once need no sampling.

All tokens travel once: all passes over the buckets read the same shuffle. Counts come from every
document of the table; the number of buckets follows the bytes of text.

Discounts are n1 / (n1 + 2 n2) of the counts of counts at hand. Words are lower-cased and stand for 40-bit
hashes. Defined results: a null, empty or wordless text has 0 tokens and null perplexity; the first word's
context is the start of a text; a null id is kept; repeated rows are scored as often as they occur, and
each is evidence for the others; a very long text is a pass of its own, in memory in proportion to itself; equal
weights are drawn between, by a seed, so results repeat; an empty table gives an empty result. Columns other than
id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

PASS = 6 << 20
BUCKET_BYTES = 9 << 20  # of text, about 1.5 million tokens
START = np.uint64(0)
WORD_BYTES = 5
GROUPS = 8
SEATING = -1  # instead of a part
OUT = "doc_id long, tokens int, log_prob double, perplexity double"
_SENT = "bucket int, pass long, kind int, data binary"
_STATS = "part int, bucket int, n int, data binary"
_BACK = "bucket int, part int, customers long, tables long, data binary"


def pack_words(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]).tobytes()


def unpack_words(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // WORD_BYTES, 8), np.uint8)
    out[:, :WORD_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, WORD_BYTES)
    return out.view("<u8").ravel().astype(np.uint64)


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def expand(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte of the same weight, so that leading zeros lie together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def bigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and word of every token, and tokens before each text."""
    buf, offsets = K.buffer(pc.utf8_lower(texts))
    starts, ends, counts = K.spans(buf, offsets)
    w = (K.hashes(buf, starts, ends) >> np.uint64(64 - 8 * WORD_BYTES)) | np.uint64(1)
    u = np.r_[START, w[:-1]] if len(w) else w.copy()
    u[counts[:-1][np.diff(counts) > 0]] = START
    return u, w, counts


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return K.mix(K.mix(u) ^ w)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, a place of each, and the number of each element's value; the sort needn't be stable."""
    order = np.argsort(x)
    new = x[order[1:]] != x[order[:-1]]
    lead = order[np.flatnonzero(np.r_[True, new][: len(x)])]
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(np.r_[False, new][: len(x)])
    return x[lead], lead, at


def _deal(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), count()
        for batch in batches:
            for b in K.passes(batch, limit=PASS):
                u, w, counts = bigrams(b.column("text"))
                name = part << 32 | next(number)
                ids = b.column("doc_id")
                null = ids.is_null().to_numpy(zero_copy_only=False)
                bucket = (pair_hash(u, w) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")  # within a bucket, by text
                text = K.owners(counts)[order].astype(np.uint32)
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                uw, ww = np.frombuffer(pack_words(u[order]), np.uint8), np.frombuffer(pack_words(w[order]), np.uint8)
                rows = [(name % buckets, 1, np.asarray(pc.fill_null(ids, 0)).astype(np.int64).tobytes() + null.tobytes() + np.diff(counts).astype(np.int32).tobytes())]
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    lo, hi = int(cuts[k]), int(cuts[k + 1])
                    own = text[lo:hi]
                    new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    runs = np.diff(np.r_[new, hi - lo])
                    head = np.array([hi - lo, len(new)], np.int32)
                    rows.append((k, 0, squeeze(b"".join((head.tobytes(), own[new].tobytes(), runs.astype(np.int32).tobytes(), uw[lo * WORD_BYTES : hi * WORD_BYTES].tobytes(), ww[lo * WORD_BYTES : hi * WORD_BYTES].tobytes())))))
                k, kind, data = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array([name] * len(k), pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["bucket", "pass", "kind", "data"])

    return run


class Bucket:
    """The tokens of a bucket and the seating of its (context, word) pairs."""

    def __init__(self, rows: pa.Table):
        names, kinds, data = rows.column("pass").to_numpy(), rows.column("kind").to_numpy(), rows.column("data")
        order = np.lexsort((kinds, names))  # in the order of the passes, whatever the order of arrival
        us, ws, self.texts, self.runs, self.passes, self.ids = [], [], [], [], [], []
        for i in order.tolist():
            raw = data[i].as_py()
            if kinds[i]:
                self.ids.append((int(names[i]), raw))
                continue
            raw = expand(raw)
            n, m = np.frombuffer(raw, np.int32, 2).tolist()
            at = 8
            self.texts.append(np.frombuffer(raw, np.uint32, m, at))
            self.runs.append(np.frombuffer(raw, np.int32, m, at + 4 * m))
            at += 8 * m
            us.append(unpack_words(raw[at : at + n * WORD_BYTES]))
            ws.append(unpack_words(raw[at + n * WORD_BYTES :]))
            self.passes.append(int(names[i]))
        none = np.zeros(0, np.uint64)
        self.seat(np.concatenate([none, *us]), np.concatenate([none, *ws]))

    def seat(self, u: np.ndarray, w: np.ndarray) -> None:
        _, lead, self.pair = distinct(pair_hash(u, w))
        self.c = np.bincount(self.pair, minlength=len(lead))
        pu, pw = u[lead], w[lead]
        self.words, _, at = distinct(np.concatenate([pu, pw]))
        self.context, self.dish = at[: len(pu)], at[len(pu) :]
        self.many = np.flatnonzero(self.c > 1)
        self.go_on(np.zeros(int(self.c[self.many].sum()), np.uint32))  # to begin with, one table for each pair
        n1, n2 = np.count_nonzero(self.c == 1), np.count_nonzero(self.c == 2)
        self.discount = min(0.95, max(0.05, n1 / max(1, n1 + 2 * n2)))

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """The first place of each pair of more than one customer, one more at the end, and the pair of each place."""
        size = self.c[self.many]
        return np.cumsum(np.r_[0, size]), np.repeat(np.arange(len(size)), size)

    def go_on(self, seating: np.ndarray) -> None:
        """Takes up a seating: of each customer of the pairs that have several, its table, named by a place of its pair."""
        first, pair = self.places()
        self.seating = seating
        taken = np.bincount(first[pair] + seating.astype(np.int64), minlength=len(pair)) > 0
        self.t = np.ones(len(self.c), np.int64)
        self.t[self.many] = np.bincount(pair[taken], minlength=len(self.many))

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word: tables that serve it, customers and tables of its restaurant; of this bucket."""
        n = len(self.words)
        f = lambda at, x: np.bincount(at, x, n).astype(np.int64)
        return f(self.dish, self.t), f(self.context, self.c), f(self.context, self.t)

    def gibbs(self, parent: np.ndarray, customers: np.ndarray, tables: np.ndarray, strength: float, sweeps: int, burn: int, rng: np.random.Generator, lone: np.ndarray | None = None) -> np.ndarray:
        """Averaged probability of each pair, a token of it taken out. parent: probability of each word; customers, tables: of each word's restaurant, in all buckets. lone: parent with one table of the word out of it."""
        d, p_dish = self.discount, parent[self.dish]
        p_lone = p_dish if lone is None else lone[self.dish]
        elsewhere = tables - self.counts()[2]
        own = np.bincount(self.context, self.t, len(self.words))
        rest = strength + customers[self.context] - 1.0
        total = np.zeros(len(self.c))
        many = self.many
        size = self.c[many]
        first, pair = self.places()
        n = int(first[-1])
        table = first[pair] + self.seating.astype(np.int64)
        sitting = np.bincount(table, minlength=n)
        t = self.t[many]
        ctx, word_p, lone_p = self.context[many], p_dish[many], p_lone[many]
        place = np.arange(n) - first[pair]
        mass, seen = np.zeros(len(many)), 0
        # Places whose number within the pair is congruent are taken out together.
        place %= GROUPS
        groups = [np.flatnonzero(place == g) for g in range(GROUPS)]
        left = [size[pair[g]] - np.bincount(pair[g], minlength=len(many))[pair[g]] for g in groups]  # customers still seated in the pair
        del place
        mark = np.zeros(n, np.int32)
        for sweep in range(sweeps):
            kept = sweep >= burn
            if kept:
                seen += 1
                base = strength + d * (elsewhere + own)[self.context]
                single = self.c == 1
                total[single] += ((base[single] - d) * p_lone[single]) / np.maximum(rest[single], 1e-12)
            for g, stay in zip(groups, left, strict=True):
                if not len(g):
                    continue
                k = pair[g]
                at = ctx[k]
                old = table[g]
                np.subtract.at(sitting, old, 1)
                closed = sitting[old] == 0
                gone = old[closed]
                mark[gone] = np.arange(len(gone), dtype=np.int32)
                gone = pair[gone[mark[gone] == np.arange(len(gone), dtype=np.int32)]]  # the pair of each table, once
                if kept:
                    alone_out = size[k] - 1 - d * (t[k] - closed)  # old tables' mass for a customer, if it were the only one out
                # To each customer the others' tables of its context are there, though they are out as well.
                there = strength + d * (elsewhere[at] + own[at]) - d * closed
                np.subtract.at(t, gone, 1)
                np.subtract.at(own, ctx[gone], 1.0)
                table[g] = -1
                old_mass = stay - d * t[k]
                # Whose table is gone takes it out of the parent.
                new_mass = there * np.where(closed, lone_p[k], word_p[k])
                if kept:
                    # The other customers taken out with it still count for its probability.
                    mass += np.bincount(k, np.maximum(alone_out, 0) + new_mass, len(many))
                is_new = rng.random(len(g)) * (np.maximum(old_mass, 0) + new_mass) < new_mass
                is_new |= stay == 0
                # An old table: that of another customer, accepted in proportion to size less discount.
                chosen = np.full(len(g), -1, np.int64)
                ask = np.flatnonzero(~is_new)
                begin, many_of = first[k[ask]], size[k[ask]]
                while len(ask):
                    to = table[begin + (rng.random(len(ask)) * many_of).astype(np.int64)]
                    done = np.flatnonzero(to >= 0)
                    done = done[np.flatnonzero(rng.random(len(done)) < 1 - d / sitting[to[done]])]
                    rejected = np.ones(len(ask), bool)
                    rejected[done] = False
                    again = np.flatnonzero(rejected)
                    chosen[ask[done]] = to[done]
                    ask, begin, many_of = ask[again], begin[again], many_of[again]
                # New tables: the free places of the pair, one each.
                ask = np.flatnonzero(is_new)
                of = k[ask]
                empty = sitting == 0
                free, before = np.flatnonzero(empty), np.cumsum(empty, dtype=np.int32)
                begin = first[of]
                head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)])
                chosen[ask] = free[before[begin] - empty[begin] + np.arange(len(of)) - np.repeat(head, np.diff(np.r_[head, len(of)]))]
                np.add.at(t, of, 1)
                np.add.at(own, ctx[of], 1.0)
                np.add.at(sitting, chosen, 1)
                table[g] = chosen
        self.t[many], self.seating = t, (table - first[pair]).astype(np.uint32)
        self.alone = np.ones(len(self.c), np.int64)  # tables of one customer
        self.alone[many] = np.bincount(pair, sitting == 1, len(many)).astype(np.int64)
        if seen:
            total[many] = mass / size / np.maximum(rest[many], 1e-12)
            total /= seen
        return total


def _counts(parts: int):
    def work(rows: pa.Table) -> pa.Table:
        return _stats(Bucket(rows), int(rows.column("bucket")[0].as_py()), parts)

    return work


def _bounds(parts: int) -> np.ndarray:
    return np.array([(k << (8 * WORD_BYTES)) // parts for k in range(parts + 1)], np.uint64)


def _stats(b: Bucket, bucket: int, parts: int) -> pa.Table:
    """One row for every part of the parent: the words of this bucket that belong there."""
    served, customers, tables = b.counts()
    # Words are sorted and parts are ranges of them, so a message is a run, sent as differences.
    cuts = np.searchsorted(b.words, _bounds(parts))
    data = []
    for k in range(parts):
        own = slice(cuts[k], cuts[k + 1])
        data.append(squeeze(planes(np.diff(b.words[own], prepend=np.uint64(0))) + planes(np.concatenate([served[own], customers[own], tables[own]]).astype(np.uint32))))
    return pa.table({"part": pa.array(np.arange(parts), pa.int32()), "bucket": pa.array([bucket] * parts, pa.int32()), "n": pa.array(np.diff(cuts), pa.int32()), "data": pa.array(data, pa.binary())})


def _parent(parts: int, base_size: float, strength: float, sweeps: int, seed: int):
    """Adds up the counts of a part's words and seats the parent's customers; back to each bucket go its own words, and its seating if it sent one."""

    def work(rows: pa.Table) -> pa.Table:
        part = int(rows.column("part")[0].as_py())
        passed = rows.filter(pc.less(rows.column("bucket"), 0))
        rows = rows.filter(pc.greater_equal(rows.column("bucket"), 0))
        buckets, ns = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
        order = np.argsort(buckets, kind="stable")
        buckets, ns = buckets[order], ns[order]
        raw = [rows.column("data")[i].as_py() for i in order.tolist()]
        raw = [expand(x) for x in raw]
        words = np.concatenate([np.cumsum(unplanes(x[: 8 * n], "<u8"), dtype=np.uint64) for x, n in zip(raw, ns.tolist(), strict=True)])
        numbers = np.concatenate([unplanes(x[8 * n :], "<u4").reshape(3, n) for x, n in zip(raw, ns.tolist(), strict=True)], 1).astype(np.float64)
        uniq, at = np.unique(words, return_inverse=True)
        served, customers, tables = (np.bincount(at, x, len(uniq)) for x in numbers)
        b = Bucket.__new__(Bucket)
        has = np.flatnonzero(served > 0)
        b.c = served[has].astype(np.int64)
        n1, n2 = np.count_nonzero(b.c == 1), np.count_nonzero(b.c == 2)
        b.discount = min(0.95, max(0.05, n1 / max(1, n1 + 2 * n2)))
        b.many = np.flatnonzero(b.c > 1)
        b.go_on(np.zeros(int(b.c[b.many].sum()), np.uint32))
        # One restaurant for all words; the tables of the other parts are about as many as this part's.
        b.words, b.context, b.dish = np.arange(1), np.zeros(len(has), np.int64), np.zeros(len(has), np.int64)
        all_tables, all_customers = np.array([len(has) * parts]), np.array([b.c.sum() * parts])
        b.gibbs(np.array([1.0 / base_size]), all_customers, all_tables, strength, sweeps, sweeps, np.random.Generator(np.random.PCG64(seed + 7919 * part)))
        seated = np.zeros((3, len(uniq)))
        seated[:, has] = b.c, b.t, b.alone
        data, cuts = [], np.cumsum(np.r_[0, ns])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            # In the order that the bucket sent: seating of the words it serves, restaurants of its contexts.
            dish, context = at[lo:hi][numbers[0, lo:hi] > 0], at[lo:hi][numbers[1, lo:hi] > 0]
            data.append(np.array([b.discount], np.float32).tobytes() + squeeze(planes(np.concatenate([seated[0, dish], seated[1, dish], seated[2, dish], customers[context], tables[context]]).astype(np.uint64))))
        n, m = len(buckets), passed.num_rows
        own = [-1 - x for x in passed.column("bucket").to_pylist()]
        return pa.table(
            {
                "bucket": pa.array([*buckets.tolist(), *own], pa.int32()),
                "part": pa.array([part] * n + [SEATING] * m, pa.int32()),
                "customers": pa.array([int(b.c.sum())] * n + [0] * m, pa.int64()),
                "tables": pa.array([int(b.t.sum())] * n + [0] * m, pa.int64()),
                "data": pa.array(data + passed.column("data").to_pylist(), pa.binary()),
            }
        )

    return work


def _from_parent(b: Bucket, back: pa.Table, base_size: float, strength: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parent's probability, customers and tables for each word of the bucket, and the probability with one table of the word out."""
    customers, tables = float(np.sum(back.column("customers").to_numpy())), float(np.sum(back.column("tables").to_numpy()))
    served, sat, _ = b.counts()
    cuts = np.searchsorted(b.words, _bounds(back.num_rows))
    out, discounts = np.zeros((5, len(b.words))), []
    for part, x in zip(back.column("part").to_pylist(), back.column("data"), strict=True):
        raw = x.as_py()
        discounts.append(np.frombuffer(raw, np.float32, 1)[0])
        found = unplanes(expand(raw[4:]), "<u8").astype(np.float64)
        own = np.arange(cuts[part], cuts[part + 1])
        dish, context = own[served[own] > 0], own[sat[own] > 0]
        n, m = len(dish), len(context)
        out[0, dish], out[1, dish], out[4, dish] = found[: 3 * n].reshape(3, n)
        out[2, context], out[3, context] = found[3 * n :].reshape(2, m)
    d = float(np.mean(discounts))
    p = (np.maximum(out[0] - d * out[1], 0) + (strength + d * tables) / base_size) / (strength + customers)
    gone = out[4] / np.maximum(out[0], 1)  # the expected share of a parent's table that goes with a customer of it
    lone = (np.maximum(out[0] - 1 - d * (out[1] - gone), 0) + (strength + d * (tables - gone)) / base_size) / (strength + customers - 1)
    return p, out[2], out[3], lone


def _go_on(b: Bucket, back: pa.Table) -> pa.Table:
    """What the parent sent; the bucket goes on from its last seating, if that is among it."""
    own = pc.equal(back.column("part"), SEATING)
    for x in back.filter(own).column("data"):
        b.go_on(unplanes(expand(x.as_py()), "<u4"))
    return back.filter(pc.invert(own))


def _again(parts: int, base_size: float, strength: float, sweeps: int, seed: int):
    def work(key, rows: pa.Table, back: pa.Table) -> pa.Table:
        b = Bucket(rows)
        bucket = int(rows.column("bucket")[0].as_py())
        *given, lone = _from_parent(b, _go_on(b, back), base_size, strength)
        b.gibbs(*given, strength, sweeps, sweeps, np.random.Generator(np.random.PCG64(seed + bucket)), lone)
        # Sent by way of a part, so that nothing is read twice: its bucket is written as a negative number.
        seating = pa.table({"part": pa.array([bucket % parts], pa.int32()), "bucket": pa.array([-1 - bucket], pa.int32()), "n": pa.array([len(b.seating)], pa.int32()), "data": pa.array([squeeze(planes(b.seating))], pa.binary())})
        return pa.concat_tables([_stats(b, bucket, parts), seating])

    return work


def _score(base_size: float, strength: float, sweeps: int, burn: int, seed: int):
    def work(key, rows: pa.Table, back: pa.Table) -> pa.Table:
        b = Bucket(rows)
        bucket = int(rows.column("bucket")[0].as_py())
        names, kinds, data = [], [], []
        if len(b.c):
            *given, lone = _from_parent(b, _go_on(b, back), base_size, strength)
            p = b.gibbs(*given, strength, sweeps, burn, np.random.Generator(np.random.PCG64(seed + bucket)), lone)
            log_p = np.log(np.maximum(p, 1e-300))[b.pair]
            at = 0
            for name, texts, runs in zip(b.passes, b.texts, b.runs, strict=True):
                n = int(runs.sum())
                sums = np.add.reduceat(log_p[at : at + n], np.cumsum(np.r_[0, runs])[:-1])
                at += n
                names.append(name)
                kinds.append(0)
                data.append(texts.astype(np.uint32).tobytes() + sums.astype(np.float32).tobytes())
        for name, raw in b.ids:
            names.append(name)
            kinds.append(1)
            data.append(raw)
        return pa.table({"pass": pa.array(names, pa.int64()), "kind": pa.array(kinds, pa.int32()), "data": pa.array(data, pa.binary())})

    return work


def _sum(rows: pa.Table) -> pa.Table:
    """A pass' documents with the log-probabilities that the buckets found for them."""
    kinds, data = rows.column("kind").to_numpy(), rows.column("data")
    raw = data[int(np.flatnonzero(kinds == 1)[0])].as_py()
    n = len(raw) // 13
    ids, null, size = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, bool, n, 8 * n), np.frombuffer(raw, np.int32, n, 9 * n)
    log_p = np.zeros(n)
    for i in np.flatnonzero(kinds == 0).tolist():
        x = data[i].as_py()
        m = len(x) // 8
        log_p[np.frombuffer(x, np.uint32, m)] += np.frombuffer(x, np.float32, m, 4 * m)
    empty = size == 0
    return pa.table({"doc_id": pa.array(ids, mask=null), "tokens": pa.array(size), "log_prob": pa.array(log_p, mask=empty), "perplexity": pa.array(np.exp(-log_p / np.maximum(size, 1)), mask=empty)})


def perplexity(docs: DataFrame, strength: float = 1.0, sweeps: int = 4, burn: int = 2, refreshes: int = 1, base_size: float = 2.0**22, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row a document: OUT. `sweeps` of each seating, `burn` of the last not averaged; `refreshes` of the parent after the first."""
    if burn >= sweeps:
        raise ValueError("burn must be less than sweeps")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    parts = max(1, math.ceil(buckets / 4))
    dealt = rows.mapInArrow(_deal(buckets), _SENT)
    stats = dealt.groupBy("bucket").applyInArrow(_counts(parts), _STATS)
    parent = _parent(parts, base_size, strength, sweeps, seed)
    for i in range(refreshes):
        back = stats.groupBy("part").applyInArrow(parent, _BACK)
        stats = dealt.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(_again(parts, base_size, strength, sweeps, seed + 1000 * (i + 1)), _STATS)
    back = stats.groupBy("part").applyInArrow(parent, _BACK)
    scored = dealt.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(_score(base_size, strength, sweeps, burn, seed), "pass long, kind int, data binary")
    return scored.groupBy("pass").applyInArrow(_sum, OUT)
