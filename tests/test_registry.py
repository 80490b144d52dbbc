import math
from collections import Counter

import duckdb
import pytest
from textloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    out = Counter()
    for r in df[sorted(df.columns)].itertuples(index=False, name=None):
        out[tuple(None if x is None or (isinstance(x, float) and math.isnan(x)) else round(float(x), 6) if isinstance(x, float) else x for x in r)] += 1
    return out


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, duck, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_embedded_hybrid_scores_are_those_of_partial_ratio(spark, tmp_path):
    from textloom.functions.lexical import partial_ratio
    from textloom.functions.text import normalize_tokens
    from textloom.providers import HashingEmbedding
    from pyspark.sql import functions as F

    # No topic of the registry's is in these texts.
    texts = ["red cats run fast", "red cat runs faster", "blue fish swim", "blue fishy swims"]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.text_a: r.score for r in registry.queries()["hybrid_score_embedded"](spark, str(tmp_path)).collect()}
    known = HashingEmbedding().embed(spark.createDataFrame([(t,) for t in texts], "text string")).withColumn("w", F.array_sort(F.array_distinct(normalize_tokens(F.col("text")))))
    by = {r.text: r for r in known.collect()}
    for a, b in zip(texts, texts[1:]):
        cosine = sum(x * y for x, y in zip(by[a].embedding, by[b].embedding))
        raw = 0.85 * cosine + 0.1 * partial_ratio(" ".join(by[a].w), " ".join(by[b].w)) / 100
        assert got[a] == pytest.approx(1 / (1 + math.exp(-15 * (raw - 0.65))), rel=1e-4)


def test_the_taxonomy_reads_every_document(spark, sf_dir, monkeypatch):
    seen = []
    made = lambda units: registry.taxonomy.Taxonomy(units.selectExpr("source id", "'' description", "array(text) terms"), *[None] * 4)
    monkeypatch.setattr(registry.taxonomy, "build", lambda units, *a, **k: seen.append(units) or made(units))
    got = registry.queries()["taxonomy_from_texts"](spark, sf_dir)
    assert got.count() == registry._units(spark, sf_dir).count() > 1000


def against_sql(spark, tmp_path, name, table, rows_, schema):
    """A query over a small table of its own gives what its SQL does."""
    spark.createDataFrame(rows_, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    got = registry.queries()[name](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.sql(registry.oracle_sql()[name]).df())


def test_a_blank_text_is_cleaned_to_an_empty_one(spark, tmp_path):
    texts = ["", " ", "\n \n", "\ta\nb ", " \r\n", None, "a"]
    against_sql(spark, tmp_path, "cleaned_texts", "documents", list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("name", ["topic_extract_terms", "contexts_of_term", "term_contexts"])
def test_terms_are_extracted_once(spark, sf_dir, monkeypatch, name):
    """They are looked at more than once, and each look would count all n-grams again."""
    written, store = [], registry.store
    monkeypatch.setattr(registry, "store", lambda df, name: written.append(name) or store(df, name))
    assert registry.queries()[name](spark, sf_dir).count() and written == ["extracted-terms"]
