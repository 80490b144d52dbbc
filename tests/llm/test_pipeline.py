import pytest
from pyspark.sql import functions as F

from .cases import documents, empty

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    documents(spark).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "toxicity", "n-gram Jaccard join", "suffix-array dedup", "packing"]


def test_each_stage_keeps_the_columns(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names and 0 < docs.count() <= before
    assert "pack_id" in docs.columns and docs.count() > 0


def test_every_pack_is_rebuilt_from_the_result_alone(spark, folder, tmp_path):
    """Against a plain loop: words of what the last stage but one kept, in packs that hold at most 2048."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    texts, packs = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.piece)):
        texts.setdefault(r.doc_id, []).append(r.text)
        packs.setdefault(r.pack_id, []).append(r)
        assert len(r.text.split()) == r.length
    want = {r.doc_id: r.text for r in docs.collect() if r.text.split()}
    assert {k: "".join(v) for k, v in texts.items()} == want and len(want) == docs.count()
    for own in packs.values():
        own.sort(key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        assert len(" ".join(r.text for r in own).split()) == own[0].pack_length <= 2048


def test_language_id_drops_junk_and_relabels(spark):
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("lang"))), d)
    assert kept.columns == docs.columns
    found = {r.doc_id: r.lang for r in kept.select("doc_id", "lang").collect()}
    lang, junk = {}, set()
    for r in docs.collect():
        lang[r.doc_id] = r.lang
        marks = sum(r.text.count(x) for x in ("###", "$$$", "%%%", "&&&", "***"))
        if marks > 0.6 * len(r.text.split()):
            junk.add(r.doc_id)
    assert len(junk) > 20 and not junk & set(found)
    good = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").where("quality = 1").collect()}
    assert len(good & set(found)) >= 0.995 * len(good)
    blank = [i for i in found if i % 5 == 0]
    assert sum(found[i] == lang[i] for i in blank) >= 0.98 * len(blank)


def test_an_empty_table_goes_through(spark, folder):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_toxic_labelled_documents_go(spark):
    """At 399 labels most toxic documents are known; at tens of them no token is significant, and none is."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, docs, d).select("doc_id").collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    clean, toxic = {r.doc_id for r in labels if r.toxic == 0}, {r.doc_id for r in labels if r.toxic == 1}
    assert len(kept & clean) >= 0.995 * len(clean) and len(toxic - kept) >= 0.6 * len(toxic)


def test_run_on_the_tables(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert 0 < got.select("doc_id").distinct().count() <= spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert got.groupBy("pack_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
