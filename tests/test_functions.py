import math
import re
import uuid

import pytest
from pyspark.sql import functions as F
from textloom.functions import text as T
from textloom.functions import vector as V
from textloom.functions.lexical import partial_ratio, syntactic_similarity
from textloom.functions.words import LEXICAL_STOP_WORDS, TERM_STOP_WORDS


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_tokenize(spark):
    for text in ("Hello, World! foo_bar x1 1x", "éa Straße naïve abc", "", "A-b C.D"):
        assert [x for x in one(spark, T.tokenize(F.col("t")), t=text)] == re.findall(r"\b[a-zA-Z][a-zA-Z0-9]*\b", text.lower())


def test_normalize_tokens(spark):
    assert one(spark, T.normalize_tokens(F.col("t")), t="How many Customers, do I have?") == ["customers"]
    assert one(spark, T.normalize_tokens(F.col("t")), t="the a an is") == []
    assert one(spark, T.normalize_tokens(F.col("t")), t="") == []


def test_stop_words():
    assert len(TERM_STOP_WORDS) == 87 and len(LEXICAL_STOP_WORDS) == 147
    assert TERM_STOP_WORDS - LEXICAL_STOP_WORDS == {"every", "whose"}


def test_sentence_units(spark):
    few = "One sentence is here. Another sentence follows! Short. Third sentence ends?"
    assert one(spark, T.sentence_units(F.col("t")), t=few) == ["One sentence is here.", "Another sentence follows!", "Third sentence ends?"]
    many = "a\n b \n\nc\nd\ne. f"
    assert one(spark, T.sentence_units(F.col("t")), t=many) == ["a", "b", "c", "d", "e. f"]
    assert one(spark, T.line_sentences(F.col("t")), t=" A long enough LINE \nshort") == ["a long enough line"]


def test_cosine(spark):
    c = V.cosine_similarity(F.col("a"), F.col("b"))
    for a, b, want in (([1.0, 2.0, 3.0], [1.0, 2.0, 3.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 2.0], [-1.0, -2.0], -1), ([0.0, 0.0], [1.0, 1.0], 0)):
        df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
        assert abs(df.select(c.alias("x")).first().x - want) < 1e-12
    with pytest.raises(Exception, match="differ in length"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(c).collect()


def test_calibration(spark):
    for raw, mid, steep in ((0.5, 0.5, 10.0), (0.7, 0.5, 10.0), (0.3, 0.5, 10.0), (0.95, 0.65, 15.0)):
        assert abs(one(spark, V.calibrate_score(F.lit(raw), mid, steep)) - 1 / (1 + math.exp(-steep * (raw - mid)))) < 1e-12
    assert one(spark, V.calibrate_score(F.lit(-1e6))) == 0.0


def test_cluster_uuid(spark):
    for name in ("a", "doc-17", "größe"):
        assert one(spark, V.cluster_uuid(F.lit(name))) == f"cluster_{uuid.uuid5(uuid.NAMESPACE_DNS, name)}"


def test_lexical(spark):
    assert partial_ratio("abc", "xxabcxx") == 100 and partial_ratio("", "") == 0 and partial_ratio("", "a") == 0
    assert partial_ratio("abcd", "wxyz") == 0
    assert abs(partial_ratio("abcd", "abxd") - 75) < 1e-9
    df = spark.createDataFrame([("customer count", "count customer"), ("", ""), (None, "a b")], "a string, b string")
    assert [r.x for r in df.select(syntactic_similarity(F.col("a"), F.col("b")).alias("x")).collect()] == [1.0, 0.0, None]
    assert one(spark, syntactic_similarity(F.lit("apple banana"), F.lit("orange grape"), "jaccard")) == 0
    with pytest.raises(ValueError):
        syntactic_similarity(F.lit("a"), F.lit("b"), "other")


def test_embedding_text(spark):
    assert one(spark, T.clean_for_embedding(F.lit(" a\nb "))) == "a b"
    with pytest.raises(Exception, match="empty text"):
        spark.range(1).select(T.clean_for_embedding(F.lit(" \n"))).collect()
