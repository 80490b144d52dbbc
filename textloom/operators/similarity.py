"""Hybrid similarity of text pairs: embeddings, tokens and topics, blended and calibrated."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textloom.functions.lexical import syntactic_similarity
from textloom.functions.vector import MIDPOINT, STEEPNESS, calibrate_score, cosine_similarity, jaccard
from textloom.providers import Embedding, embed_distinct
from textloom.sources.io import dealt
from textloom.sources.shared import store


#: Terms of one automaton.
LOOKED_FOR = 200_000


@dataclass(frozen=True)
class BlendConfig:
    weight_semantic: float = 0.85
    weight_syntactic: float = 0.10
    weight_topic: float = 0.05
    midpoint: float = MIDPOINT
    steepness: float = STEEPNESS
    method: str = "partial_ratio"
    #: A single pair stretches the cosine away from 0.65; a batch of pairs doesn't.
    rescale: bool = False

    def weights(self, with_topics: bool) -> tuple[float, float, float]:
        if with_topics:
            return self.weight_semantic, self.weight_syntactic, self.weight_topic
        total = self.weight_semantic + self.weight_syntactic
        return (self.weight_semantic / total, self.weight_syntactic / total, 0.0) if total > 0 else (0.5, 0.5, 0.0)


def rescale_cosine(c: Column) -> Column:
    return F.when(c <= 0.65, c * 0.8).otherwise(c * 1.2)


def blend(cosine: Column, syntactic: Column, topic: Column | None = None, config: BlendConfig = BlendConfig()) -> Column:
    sem, syn, top = config.weights(topic is not None)
    raw = F.lit(sem) * (rescale_cosine(cosine) if config.rescale else cosine) + F.lit(syn) * syntactic
    if topic is not None:
        raw = raw + F.lit(top) * topic
    return calibrate_score(raw, config.midpoint, config.steepness)


def extract_topics(texts: DataFrame, term_topic: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, topics): sorted ids of topics with a term that the text contains, whatever its case, word boundaries or not; none is an empty array.

    A taxonomy's terms are looked for all at once, by an automaton, in one pass over the texts; more than
    LOOKED_FOR, which no broadcast should hold, go through the texts an automaton of so many at a time.
    """
    terms = term_topic.select(F.lower("term").alias("term"), "topic_id").where("term is not null and topic_id is not null").distinct()
    list_kind = T.ArrayType(term_topic.schema["topic_id"].dataType)
    shares = max(1, math.ceil(terms.count() / LOOKED_FOR))
    rows = texts.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text"))
    key_kind = rows.schema["key"].dataType
    found = None
    for share in range(shares):
        own = terms.where(F.pmod(F.xxhash64("term"), F.lit(shares)) == share) if shares > 1 else terms
        held = rows.sparkSession.sparkContext.broadcast([(r.term, r.topic_id) for r in own.collect()])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            topics: dict[str, set] = {}
            for term, topic in held.value:
                topics.setdefault(term, set()).add(topic)
            everywhere = topics.pop("", set())  # an empty term is in every text
            finder = ahocorasick.Automaton()
            for term, ids in topics.items():
                finder.add_word(term, ids)
            finder.make_automaton()
            for b in batches:
                out = []
                for x in b.column("text").to_pylist():
                    hits = set() if x is None else set(everywhere)
                    if x is not None and len(finder):
                        for _, ids in finder.iter(x):
                            hits |= ids
                    out.append(sorted(hits))
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.list_(to_arrow_type(list_kind.elementType)))], ["key", "topics"])

        schema = T.StructType([T.StructField("key", key_kind), T.StructField("topics", list_kind)])
        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if shares > 1:
        found = found.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("topics")))).alias("topics"))
    return found.select(F.col("key").alias(key), "topics")


def topic_similarity(a: Column, b: Column) -> Column:
    return jaccard(a, b)


def score_pairs(pairs: DataFrame, provider: Embedding, term_topic: DataFrame | None = None, config: BlendConfig = BlendConfig()) -> DataFrame:
    """pairs (pair_id, text_a, text_b) with a column score. Each distinct text is embedded, and its topics found, once; a pair with a null text has a null score."""
    texts = pairs.select(F.explode(F.array("text_a", "text_b")).alias("text"))
    known = embed_distinct(texts, provider)
    if term_topic is not None:
        found = extract_topics(known.select("text"), term_topic, "text")
        known = known.join(found, "text")
    known = store(known, "scored-texts")
    side = lambda x: known.select(*[F.col(c).alias(f"{'text' if c == 'text' else c}_{x}") for c in known.columns])
    joined = dealt(pairs.join(side("a"), "text_a", "left").join(side("b"), "text_b", "left"))
    topic = topic_similarity(F.col("topics_a"), F.col("topics_b")) if term_topic is not None else None
    score = blend(cosine_similarity(F.col("embedding_a"), F.col("embedding_b")), syntactic_similarity(F.col("text_a"), F.col("text_b"), config.method), topic, config)
    return joined.select(*pairs.columns, F.when(F.col("text_a").isNotNull() & F.col("text_b").isNotNull(), score).alias("score"))
