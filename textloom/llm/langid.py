"""Word-level language labels of code-switched text by a linear-chain conditional random field.

Each word's potentials come from hashed features: prefixes and suffixes of 1 to 3 bytes, all 2- and
3-byte n-grams with word boundaries, the word itself, and for each language whether the lexicon learned
for it has the word. Learned transitions tie neighbours. Forward-backward gives each word's marginal
over the languages and `und` (no known language). A word that touches a run of two or more symbols (###,
%%%) is in no language: the mean marginals of the known languages are lowered by the share of such runs
among the words. A text is accepted if they are together over a half still, and its language is then the known
label with the largest, else `und` (Lafferty, McCallum and Pereira, 2001).

Trained by Adam on the exact log-likelihood of sequences spliced from labelled documents, so switches
inside a text are seen in training; `und` is learned from words whose letters are shuffled. The training
rows are a bounded sample, `train_docs` a language of at most `train_bytes` each, chosen by a hash of the id. Scoring covers every
word of every text.

`keep` has an effect on what it keeps: the lang column, where it is text, becomes the language found.

Defined results: a null, empty or wordless text has language null, share 0 and isn't accepted; words
without letters have flat potentials and follow their neighbours; ties take the label first in order;
rows repeat as they are given; a null id is kept; no labelled language means that nothing is accepted; an
empty table gives an empty result. A very long text is labelled whole, with memory in proportion to its
words times the labels. Columns other than id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .frames import map_passes

BUCKETS = 1 << 17
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#$%&*+<=>@\\^_`|~")] = True
PASS = 4 << 20
OUT = "doc_id long, language string, share double, accepted boolean, words int, segments array<struct<start:int,end:int,language:string>>"


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # BUCKETS x labels
    transitions: np.ndarray  # exponentiated
    first: np.ndarray  # exponentiated
    lexicon: np.ndarray  # sorted hashes
    members: np.ndarray  # words x languages: whether its lexicon has the word
    lex: np.ndarray  # languages x labels


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the given words, flat and grouped by word, and where each word's begin."""
    n, size = len(starts), ends - starts
    first = np.cumsum(np.r_[0, size + 1])[:-1]  # each word is followed by one boundary mark
    flat = np.full(int((size + 1).sum()) + 2, 32, np.uint32)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(np.r_[0, size])[:-1], size)
    word = np.repeat(np.arange(n), size)
    flat[first[word] + at] = buf[starts[word] + at]
    before = np.r_[np.uint32(32), flat[:-1]]
    two = before[: len(flat) - 2] * np.uint32(257) + flat[:-2]
    three = two * np.uint32(263) + flat[1:-1]
    spread = lambda x, salt: ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 0x5851F42D4C957F2D & (2**64 - 1))) >> np.uint64(47)).astype(np.int32)
    affixes = []
    for k in (1, 2, 3):
        pre, suf = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        for i in range(k):
            pre = pre * np.uint32(257) + np.where(size > i, buf[np.minimum(starts + i, ends - 1)], 0).astype(np.uint32)
            suf = suf * np.uint32(257) + np.where(size > i, buf[np.maximum(ends - 1 - i, starts)], 0).astype(np.uint32)
        affixes += [spread(pre, 10 + k), spread(suf, 20 + k)]
    affixes.append(spread(h, 30))
    # Layout by word: n-grams of two, n-grams of three, then the seven fixed ones.
    each = 2 * (size + 1) + len(affixes)
    begin = np.cumsum(np.r_[0, each])[:-1]
    out = np.empty(int(each.sum()), np.int32)
    grams_of = np.repeat(np.arange(n), size + 1)
    within = np.arange(len(grams_of)) - first[grams_of]
    out[begin[grams_of] + within] = spread(two, 1)
    out[begin[grams_of] + size[grams_of] + 1 + within] = spread(three, 2)
    tail = begin + 2 * (size + 1)
    for i, x in enumerate(affixes):
        out[tail + i] = x
    return out, begin


def memberships(model: Model, h: np.ndarray) -> np.ndarray:
    """For each word and language whether its lexicon has it."""
    out = np.zeros((len(h), len(model.lex)), np.float32)
    if len(model.lexicon) and len(h):
        i = np.minimum(np.searchsorted(model.lexicon, h), len(model.lexicon) - 1)
        hit = np.flatnonzero(model.lexicon[i] == h)
        out[hit] = model.members[i[hit]]
    return out


def potentials(model: Model, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Exponentiated potentials of distinct words, scaled so that each word's largest is 1."""
    if not len(starts):
        return np.zeros((0, len(model.labels)), np.float32)
    f, begin = features(buf, starts, ends, h)
    u = np.stack([np.add.reduceat(w[f], begin) for w in np.ascontiguousarray(model.weights.T)], 1) + memberships(model, h) @ model.lex
    u[buf[starts] < 58] = 0  # words that begin with a digit say nothing
    return np.exp(np.maximum(u - u.max(1, keepdims=True), -60)).astype(np.float32)


def marginals(emit: np.ndarray, word: np.ndarray, counts: np.ndarray, transitions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Forward-backward over all texts at once: step t handles word t of every text that has one."""
    size = np.diff(counts)
    order = np.argsort(-size, kind="stable")
    base, size = counts[:-1][order], size[order]
    active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
    t32, first = transitions.astype(np.float32), first.astype(np.float32)
    alpha = np.empty((len(word), len(first)), np.float32)
    a = np.broadcast_to(first, (len(size), len(first)))
    for t, n in enumerate(active):
        n = int(n)
        at = base[:n] + t
        a = (a[:n] if not t else a[:n] @ t32) * emit[word[at]]
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    back, held = np.zeros((0, len(first)), np.float32), 0
    flipped = t32.T.copy()
    for t in range(len(active) - 1, -1, -1):
        n = int(active[t])
        at = base[:n] + t
        if n > held:
            back = np.concatenate([back, np.ones((n - held, len(first)), np.float32)])
            held = n
        e = emit[word[at]]
        g = alpha[at] * back
        g /= g.sum(1, keepdims=True)
        alpha[at] = g
        back = (back * e) @ flipped
        back /= back.sum(1, keepdims=True)
    return alpha


def train(texts: list[tuple[str, str]], rounds: int = 50, length: int = 48, sequences: int = 3000, lexicon_docs: int = 3, seed: int = 7) -> Model | None:
    """texts: (language, text). lexicon_docs: texts of its language that a word needs for the lexicon."""
    langs = sorted({x for x, t in texts if t})
    if not langs:
        return None
    labels = [*langs, "und"]
    rng = np.random.Generator(np.random.PCG64(seed))
    arr = pc.utf8_lower(pa.array([t for _, t in texts], pa.string()))
    buf, offsets = K.buffer(arr)
    starts, ends, counts = K.spans(buf, offsets)
    ok = buf[starts] >= 58 if len(starts) else np.zeros(0, bool)
    kept = np.cumsum(np.r_[0, ok])[counts]
    starts, ends = starts[ok], ends[ok]
    if not len(starts):
        return None
    # Shuffled letters for und: appended to the buffer as words of their own.
    pick = rng.choice(len(starts), min(len(starts), 20_000), replace=False)
    pick = pick[(ends - starts)[pick] >= 3]
    noise = [rng.permutation(np.array(list(bytes(buf[s:e]).decode()))) for s, e in zip(starts[pick], ends[pick], strict=True)]
    nbuf, noff = K.buffer(pa.array(["".join(x) for x in noise], pa.string()))
    owner = np.repeat(np.arange(len(texts)), np.diff(kept))
    label = np.array([labels.index(x) for x, _ in texts])[owner]
    buf = np.concatenate([buf, nbuf])
    starts, ends = np.r_[starts, noff[:-1] + len(buf) - len(nbuf)], np.r_[ends, noff[1:] + len(buf) - len(nbuf)]
    label = np.r_[label, np.full(len(noff) - 1, len(langs))]
    h = K.hashes(buf, starts, ends)
    uniq, where, inverse = np.unique(h, return_index=True, return_inverse=True)
    # Lexica: words of at least so many texts of the language.
    doc_word = np.unique(np.stack([owner, inverse[: len(owner)]], 1), axis=0)
    members = np.zeros((len(uniq), len(langs)), bool)
    for i, lang in enumerate(langs):
        n = np.bincount(doc_word[np.array([texts[d][0] == lang for d in range(len(texts))])[doc_word[:, 0]], 1], minlength=len(uniq))
        members[:, i] = n >= lexicon_docs
    # Spliced sequences: runs of 4 to `length` words of one label.
    by_label = [np.flatnonzero(label == i) for i in range(len(labels))]
    by_label_ok = [i for i, x in enumerate(by_label) if len(x)]
    seq = np.empty((sequences, length), np.int64)
    gold = np.empty((sequences, length), np.int64)
    for s in range(sequences):
        at = 0
        while at < length:
            k = by_label_ok[rng.integers(len(by_label_ok))]
            n = min(int(rng.integers(4, length + 1)), length - at)
            begin = int(rng.integers(max(1, len(by_label[k]) - n)))
            run = by_label[k][begin : begin + n]
            seq[s, at : at + len(run)], gold[s, at : at + len(run)] = inverse[run], k
            at += len(run)
    used, seq = np.unique(seq, return_inverse=True)
    seq = seq.reshape(sequences, length)
    f, begin = features(buf, starts[where[used]], ends[where[used]], uniq[used])
    each = np.diff(np.r_[begin, len(f)])
    member = members[used].astype(np.float64)
    m = len(labels)
    params = [np.zeros((BUCKETS, m)), np.zeros((len(langs), m)), np.zeros((m, m)), np.zeros(m)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    wanted = np.zeros((len(used), m))
    np.add.at(wanted, (seq.ravel(), gold.ravel()), 1)
    wanted_t = np.zeros((m, m))
    np.add.at(wanted_t, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    wanted_first = np.bincount(gold[:, 0], minlength=m)
    flat_word = np.repeat(np.arange(len(used)), each)
    for step in range(1, rounds + 1):
        w, lex, tr, fi = params
        u = np.stack([np.add.reduceat(col[f], begin) for col in np.ascontiguousarray(w.T)], 1) + member @ lex
        e = np.exp(u - u.max(1, keepdims=True))
        et, ef = np.exp(tr), np.exp(fi)
        alphas = np.empty((length, sequences, m))
        a = ef * e[seq[:, 0]]
        alphas[0] = a = a / a.sum(1, keepdims=True)
        for t in range(1, length):
            a = (a @ et) * e[seq[:, t]]
            alphas[t] = a = a / a.sum(1, keepdims=True)
        got, got_t = np.zeros((len(used), m)), np.zeros((m, m))
        back = np.ones((sequences, m))
        for t in range(length - 1, -1, -1):
            g = alphas[t] * back
            g /= g.sum(1, keepdims=True)
            for k in range(m):
                got[:, k] += np.bincount(seq[:, t], g[:, k], len(used))
            if t:
                x = back * e[seq[:, t]]
                before = alphas[t - 1]
                got_t += et * ((before / ((before @ et) * x).sum(1, keepdims=True)).T @ x)
                back = x @ et.T
                back /= back.sum(1, keepdims=True)
        diff = (got - wanted) / seq.size
        grads = [np.stack([np.bincount(f, diff[flat_word, k], BUCKETS) for k in range(m)], 1) + 1e-6 * w, member.T @ diff + 1e-6 * lex, (got_t - wanted_t) / seq.size, (g.sum(0) - wanted_first) / seq.size]
        for p, gr, (m1, m2) in zip(params, grads, moments, strict=True):
            m1 += 0.1 * (gr - m1)
            m2 += 0.01 * (gr * gr - m2)
            p -= 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    w, lex, tr, fi = params
    inside = members.any(1)
    return Model(labels, w.astype(np.float32), np.exp(tr), np.exp(fi), uniq[inside], members[inside], lex.astype(np.float32))


def fit(docs: DataFrame, train_docs: int = 200, train_bytes: int = 1 << 16) -> Model | None:
    """train_docs, train_bytes: bounds of the sample of labelled rows a language, and of a text in it. Every language of the table is a label."""
    ranked = docs.select("doc_id", "lang", "text").where("lang is not null and doc_id is not null and text is not null").where(F.octet_length("text") <= train_bytes).select("doc_id", "lang")
    ranked = ranked.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id"))).where(F.col("rn") <= train_docs)
    ids = ranked.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= train_bytes).join(F.broadcast(ids), "doc_id").select("doc_id", "lang", "text").distinct().orderBy("lang", "doc_id", "text").collect()
    return train([(r.lang, r.text) for r in rows])


def symbol_runs(texts: pa.Array) -> np.ndarray:
    """Runs of two or more symbols in each text."""
    buf, offsets = K.buffer(texts)
    if not len(buf):
        return np.zeros(len(texts), np.int64)
    is_symbol = SYMBOLS[buf]
    before, after = np.r_[False, is_symbol[:-1]], np.r_[is_symbol[1:], False]
    edge = offsets[(offsets > 0) & (offsets < len(buf))]  # a run doesn't go on into the next text
    before[edge], after[edge - 1] = False, False
    return np.diff(np.searchsorted(np.flatnonzero(is_symbol & after & ~before), offsets))


def label(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every word, and how many words came before each text."""
    buf, offsets = K.buffer(pc.utf8_lower(texts))
    starts, ends, counts = K.spans(buf, offsets)
    h = K.hashes(buf, starts, ends)
    uniq, where, word = np.unique(h, return_index=True, return_inverse=True)
    return marginals(potentials(model, buf, starts[where], ends[where], uniq), word, counts, model.transitions, model.first), counts


def decide(model: Model, texts: pa.Array, least_known: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marginals, words before each text, and each text's label, share of it, and whether it is accepted."""
    g, counts = label(model, texts)
    size, und = np.diff(counts), len(model.labels) - 1
    sums = np.concatenate([np.zeros((1, und + 1)), np.cumsum(g, 0, dtype=np.float64)])
    mean = (sums[counts[1:]] - sums[counts[:-1]]) / np.maximum(size, 1)[:, None]
    mean[:, :und] *= (1 - np.minimum(1, symbol_runs(texts) / np.maximum(size, 1)))[:, None]
    mean[:, und] = np.where(size > 0, 1 - mean[:, :und].sum(1), 0)
    accepted = (size > 0) & (mean[:, :und].sum(1) > least_known)
    top = np.where(accepted, mean[:, :und].argmax(1), und)
    return g, counts, top, np.where(size > 0, mean[np.arange(len(top)), top], 0.0), accepted


def score(docs: DataFrame, model: Model | None, least_known: float = 0.5) -> DataFrame:
    """One row a document: OUT. Accepted if the share of its words in known languages is over `least_known`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "language", "share", "accepted", "words", "segments"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, n = shared.value, batch.num_rows
        ids = batch.column("doc_id").cast(pa.int64())
        if m is None:
            segments = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1), pa.int32()), pa.StructArray.from_arrays([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.string())], ["start", "end", "language"]))
            return pa.RecordBatch.from_arrays([ids, pa.nulls(n, pa.string()), pa.array(np.zeros(n)), pa.array(np.zeros(n, bool)), pa.array(np.zeros(n), pa.int32()), segments], names)
        g, counts, top, share, accepted = decide(m, batch.column("text"), least_known)
        size = np.diff(counts)
        best = g.argmax(1)
        text = K.owners(counts)
        new = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (text[1:] != text[:-1])]) if len(best) else np.zeros(0, np.int64)
        begin = new - counts[text[new]]
        end = np.r_[new[1:], len(best)][: len(new)] - counts[text[new]]
        tags = pa.array(m.labels)
        segments = pa.ListArray.from_arrays(pa.array(np.searchsorted(new, counts), pa.int32()), pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32()), tags.take(pa.array(best[new]))], ["start", "end", "language"]))
        language = tags.take(pa.array(top, mask=size == 0))
        return pa.RecordBatch.from_arrays([ids, language, pa.array(share), pa.array(accepted), pa.array(size, pa.int32()), segments], names)

    return map_passes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, OUT, limit=PASS)


def keep(docs: DataFrame, model: Model | None, least_known: float = 0.5) -> DataFrame:
    """The accepted documents, all columns; lang, if it is text, is the language found."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    relabel = "lang" in names and docs.schema["lang"].dataType.simpleString() == "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches if m is not None else ():
            for part in K.passes(batch, limit=PASS):
                _, _, top, _, accepted = decide(m, part.column("text"), least_known)
                own = part.filter(pa.array(accepted))
                if relabel and own.num_rows:
                    found = pa.array(m.labels, pa.string()).take(pa.array(top[accepted]))
                    own = own.set_column(names.index("lang"), "lang", found)
                yield own

    return docs.mapInArrow(run, docs.schema)
