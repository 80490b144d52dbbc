"""The corpus pipeline, from raw documents to packs.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns the documents that
go on, all columns; the last returns packs, with the text of every piece, so that nothing but its result is
needed to train on. Language ID drops documents of which half or more of the words are in no known language, or junked with
symbols, and sets `lang` to the language found; toxicity drops documents with a significant toxic passage;
the n-gram Jaccard join leaves the least id of each class; suffix-array dedup cuts the later copies of
passages out of the texts (n_chars follows); packing places what is left.

Defined results: a document whose text is null, empty or without words goes at language ID; a null id stays
in all stages, after all other ids where these decide; rows that repeat id and text go or stay together, and
are packed as often as they occur; ties go to the least id; very long texts are handled whole; an empty
table gives an empty result, and so does one without a label of language; without labels of toxicity nothing
is toxic. Columns of the caller's own names are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import jaccard, langid, packing, suffix, toxicity
from textloom.llm.frames import store, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep(docs, langid.fit(docs))


def toxic_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.cut(docs)


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("toxicity", toxic_passages),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", packs),
]

#: A conditional random field, segment statistics and a packing heuristic aren't SQL; tests/llm checks each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
