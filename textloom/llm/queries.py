"""The queries of this package's operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .frames import table

Query = Callable[[SparkSession, str], DataFrame]


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import hpylm

    return hpylm.perplexity(table(spark, sf_dir, "documents"))


def op2_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pieces

    return pieces.encode_texts(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix

    return suffix.repeats(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html

    return html.extract_pages(table(spark, sf_dir, "pages"))


def op6_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: each embedding is sounded as a WAV first."""
    from . import media

    return media.fingerprints(media.sonify(table(spark, sf_dir, "embeddings")), "id", "wav")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    return langid.score(docs, langid.fit(docs))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ego

    return ego.join(table(spark, sf_dir, "embeddings"))


def op9_embedding_near_dedup_035(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At a cosine that the tables' vectors do reach."""
    from . import ego

    return ego.join(table(spark, sf_dir, "embeddings"), 0.35)


def op9_embedding_pairs_035(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ego

    return ego.pairs(table(spark, sf_dir, "embeddings"), 0.35)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (op1_lm_scoring, op2_sentencepiece_sampling, op3_ngram_jaccard_join, op4_suffix_array_dedup, op5_html_extraction, op6_media_fingerprints, op7_language_id, op8_toxicity, op9_embedding_near_dedup, op9_embedding_near_dedup_035, op9_embedding_pairs_035, op10_packing)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from . import ego

    from . import jaccard, suffix

    return {"op4_suffix_array_dedup": suffix.oracle(), "op3_ngram_jaccard_join": jaccard.oracle(), "op9_embedding_near_dedup": ego.oracle(), "op9_embedding_near_dedup_035": ego.oracle(0.35), "op9_embedding_pairs_035": ego.pairs_oracle(0.35)}
