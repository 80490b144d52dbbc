"""Term extraction by TF-IDF over n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import line_sentences, term_type, tokenize
from textloom.functions.words import TERM_STOP_WORDS

#: Terms that one pass over the corpus looks for at once; more of them are looked up by a join instead.
LOOKED_FOR = 100_000


@dataclass(frozen=True)
class TermConfig:
    min_df: int = 2
    max_df_ratio: float = 0.8
    contexts_per_term: int = 5
    top_n: int = 5000


def ngrams(words: list[str]) -> list[str]:
    """Unigrams of more than two letters that aren't stop words; bigrams and trigrams that aren't all stop words."""
    stop = [w in TERM_STOP_WORDS for w in words]
    out = [w for w, s in zip(words, stop, strict=True) if not s and len(w) > 2]
    out += [f"{a} {b}" for a, b, s, t in zip(words, words[1:], stop, stop[1:], strict=False) if not (s and t)]
    out += [f"{a} {b} {c}" for a, b, c, s, t, u in zip(words, words[1:], words[2:], stop, stop[1:], stop[2:], strict=False) if not (s and t and u)]
    return out


class Grams:
    """All n-grams of a batch's token lists as numbers: places in the batch's vocabulary, base its size and one."""

    def __init__(self, tokens: pa.ListArray):
        tokens = pc.fill_null(tokens, [])
        size = np.asarray(pc.list_value_length(tokens)).astype(np.int64)
        words = tokens.flatten().dictionary_encode()
        self.vocabulary = words.dictionary.cast(pa.string())
        v = len(self.vocabulary)
        stop = np.asarray(pc.is_in(self.vocabulary, value_set=pa.array(sorted(TERM_STOP_WORDS))))
        small = np.asarray(pc.less(pc.utf8_length(self.vocabulary), 3))
        w = np.asarray(words.indices).astype(np.int64)
        self.base = v + 1
        unit = np.repeat(np.arange(len(size)), size)
        s = stop[w] if v else np.zeros(0, bool)
        out = [((w + 1)[~(s | small[w])], unit[~(s | small[w])])] if v else []
        for n in (2, 3):
            if len(w) >= n:
                k = len(w) - n + 1
                key, all_stop = np.zeros(k, np.int64), np.ones(k, bool)
                for i in range(n):
                    key = key * self.base + w[i : i + k] + 1
                    all_stop &= s[i : i + k]
                ok = (unit[:k] == unit[n - 1 :]) & ~all_stop
                out.append((key[ok], unit[:k][ok]))
        self.key = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64)
        self.unit = np.concatenate([x for _, x in out]) if out else np.zeros(0, np.int64)
        self.total = np.bincount(self.unit, minlength=len(size))

    def texts(self, keys: np.ndarray) -> pa.Array:
        parts, rest = [], keys.copy()
        while rest.any():
            place = rest % self.base - 1
            parts.append(self.vocabulary.take(pa.array(place, mask=place < 0)))
            rest //= self.base
        return pc.binary_join_element_wise(*reversed(parts), pa.scalar(" "), null_handling="skip") if parts else pa.array([], pa.string())

    def keys(self, terms: list[list[str]]) -> np.ndarray:
        """Of terms, as words; those with a word that the batch lacks are left out."""
        place = {x: i + 1 for i, x in enumerate(self.vocabulary.to_pylist())}
        out = []
        for words in terms:
            key = 0
            for x in words:
                if x not in place:
                    break
                key = key * self.base + place[x]
            else:
                out.append(key)
        return np.array(sorted(out), np.int64)


def token_batches(batch: pa.RecordBatch, limit: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many tokens, or one row: keys of three words then fit 63 bits."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch.column("tokens")), 0)), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def term_statistics(units: DataFrame) -> DataFrame:
    """(term, df, max_tf): documents that have the term, and its greatest share of a document's terms.

    The inverse document frequency is one number a term, so the best TF-IDF over documents needs only the
    best share: terms are counted and combined within a batch, and one aggregation on the term follows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in token_batches(whole):
                g = Grams(b.column("tokens"))
                if not len(g.key):
                    continue
                order = np.lexsort((g.unit, g.key))
                key, unit = g.key[order], g.unit[order]
                head = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])])
                tf = np.diff(np.r_[head, len(key)]) / g.total[unit[head]]
                first = np.flatnonzero(np.r_[True, key[head][1:] != key[head][:-1]])
                yield pa.RecordBatch.from_arrays([g.texts(key[head][first]), pa.array(np.diff(np.r_[first, len(head)])), pa.array(np.maximum.reduceat(tf, first))], ["term", "df", "max_tf"])

    partial = units.select(tokenize(F.col("text")).alias("tokens")).mapInArrow(run, "term string, df long, max_tf double")
    return partial.groupBy("term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"))


def extract_terms(units: DataFrame, config: TermConfig = TermConfig(), statistics: DataFrame | None = None) -> DataFrame:
    """(term, term_type, tfidf, df): the top_n terms by best TF-IDF, ties by term. df lies between min_df and floor(N * max_df_ratio). statistics: term_statistics(units), if they are at hand."""
    n = units.agg(F.count("*").alias("n"))
    scored = (statistics if statistics is not None else term_statistics(units)).crossJoin(F.broadcast(n)).where((F.col("df") >= config.min_df) & (F.col("df") <= F.floor(F.col("n") * config.max_df_ratio)))
    score = F.round(F.col("max_tf") * F.ln(F.col("n") / F.col("df")), 9)
    return scored.select("term", term_type(F.col("term")).alias("term_type"), score.alias("tfidf"), "df").orderBy(F.desc("tfidf"), "term").limit(config.top_n)


def corpus_statistics(units: DataFrame, terms: DataFrame | None = None, statistics: DataFrame | None = None) -> DataFrame:
    """One row: documents, tokens, distinct n-grams of each length before any filter on df, terms extracted."""
    tokens = units.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.size(tokenize(F.col("text")))), F.lit(0)).alias("tokens"))
    kinds = (statistics if statistics is not None else term_statistics(units)).groupBy().agg(*[F.count_if(F.size(F.split("term", " ")) == i).alias(f"{name}s") for i, name in ((1, "unigram"), (2, "bigram"), (3, "trigram"))])
    found = (terms if terms is not None else units.limit(0)).agg(F.count("*").alias("terms_extracted"))
    return tokens.crossJoin(kinds).crossJoin(found)


def term_contexts(units: DataFrame, terms: DataFrame, keep: int = 5) -> DataFrame:
    """(term, nth, sentence, source, char_start, char_end): the first `keep` lines, in order of the corpus, of units that have the term, that contain it anywhere, word boundaries or not.

    The terms of a taxonomy are few and known to every pass, so only units that have one leave it; more
    than LOOKED_FOR are found by an equi-join on the term itself. The substring test sees only lines of
    such units.
    """
    terms = terms.select("term").where("term is not null").distinct()
    first_terms = [r.term for r in terms.limit(LOOKED_FOR + 1).collect()]
    few = len(first_terms) <= LOOKED_FOR
    shared = units.sparkSession.sparkContext.broadcast([x.split(" ") for x in first_terms] if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in token_batches(whole):
                g = Grams(b.column("tokens"))
                key, unit = g.key, g.unit
                if shared.value is not None:
                    own = np.isin(key, g.keys(shared.value))
                    key, unit = key[own], unit[own]
                if not len(key):
                    continue
                order = np.lexsort((key, unit))
                key, unit = key[order], unit[order]
                new = np.r_[True, (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])]
                at = pa.array(unit[new])
                yield pa.RecordBatch.from_arrays([g.texts(key[new]), *[b.column(c).take(at) for c in ("source", "ord", "unit_no", "lines")]], ["term", "source", "ord", "unit_no", "lines"])

    prepared = units.select("source", F.col("ord").cast("long").alias("ord"), "unit_no", line_sentences(F.col("text")).alias("lines"), tokenize(F.col("text")).alias("tokens")).where(F.size("lines") > 0)
    has = prepared.mapInArrow(run, "term string, source string, ord long, unit_no int, lines array<string>")
    if not few:
        has = has.join(terms, "term", "left_semi")
    hits = has.select("term", "source", "ord", "unit_no", F.posexplode("lines").alias("line_no", "sentence")).where(F.expr("instr(sentence, term) > 0"))
    nth = F.row_number().over(Window.partitionBy("term").orderBy("ord", "unit_no", "line_no"))
    first = hits.withColumn("nth", nth).where(F.col("nth") <= keep)
    start = F.expr("instr(sentence, term) - 1")
    return first.select("term", "nth", "sentence", "source", start.alias("char_start"), (start + F.length("term")).alias("char_end"))


def contexts_of(contexts: DataFrame, term: str, keep: int = 5) -> DataFrame:
    """The first `keep` contexts of one term, in order."""
    return contexts.where((F.col("term") == term) & (F.col("nth") <= keep)).orderBy("nth")


def context_lists(contexts: DataFrame) -> DataFrame:
    """(term, sample_contexts)."""
    item = F.struct("nth", F.struct("sentence", F.col("source").alias("source_file"), F.col("char_start").cast("int").alias("char_start"), F.col("char_end").cast("int").alias("char_end")).alias("c"))
    return contexts.groupBy("term").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"]).alias("sample_contexts"))
