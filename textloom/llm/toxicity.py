"""Toxic passages as maximum-scoring segments of token log-odds.

1. Log-odds. From labelled documents, each token's log-odds between toxic and clean text with an
   informative Dirichlet prior, whose pseudo-counts follow the token's frequency in the whole corpus
   (Monroe, Colaresi and Quinn, 2008). The variance of the log-odds gives z; a document counts a token once, as
   bursts say nothing about class. Tokens with z over `z_min` and log-odds over `odds_min` make the lexicon, all others share one negative score, so that the expected score of clean text is
   below zero, as segment statistics demand.
2. Segments. The linear-time scan of Ruzzo and Tompa (1999) gives all maximal scoring segments of each
   text. Between lexicon tokens scores are constant, so the scan runs over lexicon tokens and gaps.
3. Calibration. Under the null, the best segment of n tokens follows an extreme-value law: the expected
   number of segments of score S or more is K n exp(-lambda S) (Karlin and Altschul, 1990). lambda
   solves sum p_w exp(lambda s_w) = 1 with the frequencies of all tokens of clean documents held out of the
   log-odds; K is counted on the segments of the same documents, scored as any text is: the least K with which no
   score is passed by more of them than the law says (of scores that five of them pass), so repeated words, which the law
   takes for independent, make it stricter. A text's E-value comes from the normalised sum of its r best
   segments, the best r taken.

The labelled rows are a bounded sample (`train_docs`, chosen by a hash of the id over the whole table);
near copies in it count once, so words of a document copied a hundred times don't look toxic. The
prior's counts cover all documents. Defined results: a null or empty text has no segments, E-value 1 and
is not toxic; rows repeat as they are given; without labels of both classes nothing is toxic; a null
id is kept; a document labelled both ways is toxic; an empty table gives an empty result. Of segments that tie
all are kept; a very long text is scanned whole, in time linear in its words. Columns other than id and text are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .frames import batches_of, keep_rows, map_passes, store

SEGMENT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("evalue", pa.float64())])
OUT = "doc_id long, toxic boolean, evalue double, score double, tokens int, segments array<struct<start:int,end:int,score:double,evalue:double>>"
ARROW = pa.schema([("doc_id", pa.int64()), ("toxic", pa.bool_()), ("evalue", pa.float64()), ("score", pa.float64()), ("tokens", pa.int32()), ("segments", pa.list_(SEGMENT))])


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of the lexicon
    scores: np.ndarray
    gap: float  # the score of any other token
    rate: float  # lambda
    k: float


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, and how many came before each text."""
    buf, offsets = K.buffer(pc.utf8_lower(texts))
    starts, ends, counts = K.spans(buf, offsets)
    return K.hashes(buf, starts, ends), counts


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score) by the scan of Ruzzo and Tompa."""
    found: list[list[float]] = []  # start, end, sum before, sum through
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        now = [i, i + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j -= 1
            if j < 0 or found[j][3] >= now[3]:
                found.append(now)
                break
            now = [found[j][0], now[1], found[j][2], now[3]]
            del found[j:]
    return [(int(a), int(b), d - c) for a, b, c, d in found]


def text_segments(at: np.ndarray, score: np.ndarray, gap: float) -> list[tuple[int, int, float]]:
    """Maximal segments of a text whose lexicon tokens stand at `at`; all others score `gap`."""
    flat, places, last = [], [], None
    for p, s in zip(at.tolist(), score.tolist(), strict=True):
        if last is not None and p - last > 1:
            flat.append(gap * (p - last - 1))
            places.append((last + 1, p))
        flat.append(s)
        places.append((p, p + 1))
        last = p
    return [(places[a][0], places[b - 1][1], s) for a, b, s in maximal_segments(flat)]


def sum_evalue(normal: list[float]) -> float:
    """E-value of the best sum of the r highest normalised scores S' = lambda S - ln(K n), over all r.

    The tail of a sum of r is exp(-t) t^(r-1) / (r! (r-1)!) (Karlin and Altschul, 1993); trying every r
    costs a factor 2^r, which sums to one.
    """
    best, total = math.inf, 0.0
    for r, s in enumerate(sorted(normal, reverse=True), 1):
        total += s
        if r > 1 and s <= 0:
            break
        log_tail = -total + (r - 1) * math.log(max(total, 1e-9)) - math.lgamma(r + 1) - math.lgamma(r) if r > 1 else -total
        best = min(best, log_tail + (r - 1) * math.log(2.0))
    return math.exp(min(best, 700.0))


def _bags(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    h, counts = tokens(batch.column("text"))
    order = np.argsort(h, kind="stable")  # stable: within a word, by text
    hs, ts = h[order], K.owners(counts)[order]
    new = np.r_[True, hs[1:] != hs[:-1]] if len(hs) else np.zeros(0, bool)
    once = new | np.r_[True, ts[1:] != ts[:-1]] if len(hs) else new
    words, first = hs[new], np.flatnonzero(new)
    n = np.add.reduceat(once.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])


def _labelled_bags(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """One row a document: its class, keys that near copies share, and its distinct words."""
    h, counts = tokens(batch.column("text"))
    g, of = K.grams(h, counts, 3)
    n = batch.num_rows
    keys = np.full((4, n), 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for j, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)):
            np.minimum.at(keys[j], of, g * np.uint64(odd))
        pairs = np.stack([K.mix(K.mix(keys[a]) ^ (keys[b] + np.uint64(4 * a + b))) for a in range(4) for b in range(a + 1, 4)], 1)
    text = K.owners(counts)
    order = np.lexsort((h, text))
    hs, ts = h[order], text[order]
    first = np.flatnonzero(np.r_[True, (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1])]) if len(hs) else np.zeros(0, np.int64)
    at = np.searchsorted(ts[first], np.arange(n + 1))
    # Held out clean texts are kept as they are, word by word, to count segments in.
    whole = np.asarray(batch.column("held")) & (np.asarray(batch.column("toxic")) == 0)
    every = K.lists(h[np.repeat(whole, np.diff(counts))].view(np.int64), np.cumsum(np.r_[0, np.diff(counts) * whole]))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("held"), K.lists(pairs.ravel().view(np.int64), np.arange(n + 1) * 6), K.lists(hs[first].view(np.int64), at), pa.array(np.diff(at)), every], ["doc_id", "toxic", "held", "copies", "words", "tokens", "every"])


def originals(rows: pd.DataFrame) -> np.ndarray:
    """The least id of each group of near copies: documents that share two of four minima of their 3-grams."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    seen: dict[int, int] = {}
    for doc, keys in zip(rows["doc_id"].tolist(), rows["copies"].tolist(), strict=True):
        for key in keys:
            a, b = find(doc), find(seen.setdefault(int(key), doc))
            parent[max(a, b)] = min(a, b)
    return np.array(sorted({find(x) for x in rows["doc_id"].tolist()}), np.int64)


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = 40_000, prior: float = 0.1, z_min: float = 3.3, odds_min: float = 2.0, passage_rate: float = 0.25) -> Model:
    """`train_docs`: bound of the labelled sample. `prior`: pseudo-counts as a share of the training tokens. `passage_rate`: share of lexicon tokens expected in a toxic passage."""
    spark = docs.sparkSession
    chosen = labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(train_docs)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    bags = map_passes(rows, _labelled_bags, "doc_id long, toxic int, held boolean, copies array<long>, words array<long>, tokens long, every array<long>")
    bags = store(bags, "toxic-bags")
    alone = originals(bags.select("doc_id", "copies").toPandas())  # at most train_docs rows
    kept = spark.createDataFrame(pd.DataFrame({"doc_id": alone}), "doc_id long")
    bags = bags.join(F.broadcast(kept), "doc_id").select("toxic", "words", "tokens", "held", "every")
    # The whole corpus' counts, for the prior.
    corpus = map_passes(docs.select("text"), _bags, "word long, n long").groupBy("word").agg(F.sum("n").alias("n_all"))
    corpus = store(corpus, "word-counts")
    size = {(r.toxic, r.held): (r.n, r.docs) for r in bags.groupBy("toxic", "held").agg(F.sum("tokens").alias("n"), F.count("*").alias("docs")).collect()}
    toxic, clean = float(size.get((1, False), (0, 0))[0] or 0), float(size.get((0, False), (0, 0))[0] or 0)
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -1.0, 1.0, 1.0)
    if not toxic or not clean:
        return none
    words = bags.where("not held").select("toxic", F.explode("words").alias("word"))
    words = words.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where("t > 0")
    strength = prior * (toxic + clean)
    total = F.lit(1.0) * spark_sum(corpus)
    with_all = words.join(corpus, "word").withColumn("a", F.col("n_all") / total * strength)
    odds = F.log((F.col("t") + F.col("a")) / (toxic + strength - F.col("t") - F.col("a"))) - F.log((F.col("c") + F.col("a")) / (clean + strength - F.col("c") - F.col("a")))
    z = odds / F.sqrt(1 / (F.col("t") + F.col("a")) + 1 / (F.col("c") + F.col("a")))
    lexicon = with_all.select("word", odds.alias("odds"), "t", "c", z.alias("z")).where((F.col("z") > z_min) & (F.col("odds") > odds_min)).toPandas()
    if not len(lexicon):
        return none
    lexicon = lexicon.assign(u=lexicon.word.to_numpy().view(np.uint64)).sort_values("u")
    # Letters of the score alphabet: a lexicon word is as many times likelier in a passage as its odds within the lexicon's share.
    share_toxic = lexicon.t.sum() / toxic
    scores = lexicon.odds.to_numpy() + math.log(passage_rate / max(share_toxic, 1e-9)) * (share_toxic < passage_rate)
    gap = math.log(1 - passage_rate)
    found = np.asarray(lexicon.u)
    return calibrate(bags.where("held and toxic = 0").select("every"), Model(found, scores, gap, 1.0, 1.0), spark)


def spark_sum(corpus: DataFrame) -> float:
    return float(corpus.agg(F.sum("n_all")).first()[0] or 1.0)


def calibrate(clean: DataFrame, model: Model, spark) -> Model:
    """lambda and K from clean texts (every: their words' hashes in order) that the lexicon wasn't learned from."""
    shared = spark.sparkContext.broadcast(model)

    def seen(batches):
        """(kind, score, n): lexicon tokens by score (0), segments by score (1), all tokens (2)."""
        m = shared.value
        for b in batches:
            h = np.asarray(b.column("every").flatten()).view(np.uint64)
            counts = np.r_[0, np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(b.column("every")), 0)))]
            tokens_at, found = _hits(m, h, counts)
            parts = [(0, *np.unique(np.round(m.scores[tokens_at], 2), return_counts=True)), (1, *np.unique(np.round([s for _, own in found for *_, s in own], 2), return_counts=True)), (2, np.zeros(1), np.array([len(h)]))]
            for kind, score, n in parts:
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(score), pa.int32()), pa.array(score, pa.float64()), pa.array(n, pa.int64())], ["kind", "score", "n"])

    rows = clean.mapInArrow(seen, "kind int, score double, n long").groupBy("kind", "score").agg(F.sum("n").alias("n")).toPandas()  # as many as there are scores
    return settle(model, *(rows[rows.kind == k].sort_values("score") for k in (0, 1)), float(rows[rows.kind == 2].n.sum()))


def settle(model: Model, letters: pd.DataFrame, segments: pd.DataFrame, n: float) -> Model:
    """The model with lambda and K of the scores and numbers of n tokens' lexicon tokens, and of their segments."""
    if not n:
        return model
    # With half a hit of pseudo-count spread over the lexicon, a lexicon that clean text never shows still has a rate.
    s = np.r_[letters.score.to_numpy(float), model.scores]
    p = np.r_[letters.n.to_numpy(float), np.full(len(model.scores), 0.5 / len(model.scores))] / n
    rest = max(1 - p.sum(), 1e-9)
    low, high = 1e-3, 1.0
    excess = lambda x: float((p * np.exp(np.minimum(x * s, 700))).sum() + rest * math.exp(x * model.gap) - 1)
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    model.rate = max(low, 1e-3)
    # Of the law itself, for one token a segment: what there is to say where no segment was seen.
    model.k = float((p * np.exp(np.minimum(model.rate * s, 700))).sum())
    score, over = segments.score.to_numpy(float), np.cumsum(segments.n.to_numpy(float)[::-1])[::-1]
    if (over >= 5).any():
        model.k = float(np.exp(np.max(np.log(over) + model.rate * score - math.log(n), where=over >= 5, initial=-np.inf)))
    return model


def _hits(m: Model, h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[tuple[int, list[tuple[int, int, float]]]]]:
    """Places in the lexicon of all tokens that it has, and the maximal segments of each text with one."""
    if not len(m.words) or not len(h):
        return np.zeros(0, np.int64), []
    i = np.minimum(np.searchsorted(m.words, h), len(m.words) - 1)
    hit = np.flatnonzero(m.words[i] == h)
    cuts = np.searchsorted(hit, counts)
    return i[hit], [(d, text_segments(hit[cuts[d] : cuts[d + 1]] - counts[d], m.scores[i[hit[cuts[d] : cuts[d + 1]]]], m.gap)) for d in np.flatnonzero(np.diff(cuts)).tolist()]


def judge(m: Model, texts: pa.Array, most_evalue: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[dict]]]:
    """For each text: toxic, E-value, best score, tokens, segments."""
    h, counts = tokens(texts)
    size, n = np.diff(counts), len(texts)
    toxic, evalue, best = np.zeros(n, bool), np.ones(n), np.zeros(n)
    segments: list[list[dict]] = [[] for _ in range(n)]
    for d, found in _hits(m, h, counts)[1]:
        log_kn = math.log(m.k * max(int(size[d]), 1))
        normal = [m.rate * s - log_kn for _, _, s in found]
        evalue[d] = min(1.0, sum_evalue(normal))
        best[d] = max(s for *_, s in found)
        toxic[d] = evalue[d] <= most_evalue
        segments[d] = [{"start": a, "end": b, "score": s, "evalue": min(1.0, math.exp(min(-x, 700)))} for (a, b, s), x in zip(found, normal, strict=True) if toxic[d] or math.exp(min(-x, 700)) <= most_evalue]
    return toxic, evalue, best, size, segments


def score(docs: DataFrame, model: Model, most_evalue: float = 0.003) -> DataFrame:
    """One row a document: OUT. Toxic if the E-value is at most `most_evalue`; only segments that are as significant by themselves, or in a toxic text score over zero, are listed."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        toxic, evalue, best, size, segments = judge(shared.value, batch.column("text"), most_evalue)
        return batches_of(ARROW, doc_id=batch.column("doc_id").cast(pa.int64()), toxic=toxic, evalue=evalue, score=best, tokens=size.astype(np.int32), segments=segments)

    return map_passes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, OUT)


def keep(docs: DataFrame, model: Model, most_evalue: float = 0.003) -> DataFrame:
    """The documents that aren't toxic, all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, lambda batch: ~judge(shared.value, batch.column("text"), most_evalue)[0])
