import math
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F
from textloom import schemas
from textloom.operators import cluster as C
from textloom.operators import judge, knn, taxonomy, tfidf
from textloom.operators.graph import connected_components
from textloom.operators.similarity import BlendConfig, score_pairs
from textloom.providers import CallableEmbedding, HashingEmbedding, TableEmbedding, embed_missing
from textloom.sources import io

TEXTS = [("milk.txt", "Fresh whole milk is stored cold.\nWhole milk makes fine yogurt cultures.\nYogurt cultures need warm milk."), ("cheese.txt", "Aged cheese needs whole milk.\nAged cheese is stored in a cellar.\nYogurt cultures start cheese too."), ("butter.txt", "Sweet butter comes from cream.\nCream rises on whole milk.")]


@pytest.fixture(scope="module")
def units(spark):
    return io.corpus_units(io.from_texts(spark, TEXTS)).cache()


def test_tfidf_is_the_plain_loop(spark, units):
    docs = [r.text for r in units.collect()]
    grams = [tfidf.ngrams([w for w in d.lower().replace(".", "").split()]) for d in docs]
    df = Counter(x for g in grams for x in set(g))
    want = {t: round(max(g.count(t) / max(len(g), 1) for g in grams) * math.log(len(docs) / n), 9) for t, n in df.items() if 2 <= n <= int(len(docs) * 0.8)}
    got = {r.term: r.tfidf for r in tfidf.extract_terms(units).collect()}
    assert got == want and "whole milk" in got
    assert [r.term for r in tfidf.extract_terms(units, tfidf.TermConfig(top_n=3)).collect()] == sorted(want, key=lambda t: (-want[t], t))[:3]
    assert tfidf.extract_terms(units.limit(1)).count() == 0


def test_contexts(spark, units):
    terms = tfidf.extract_terms(units)
    rows = tfidf.term_contexts(units, terms, keep=2).collect()
    assert max(Counter(r.term for r in rows).values()) == 2
    assert all(r.sentence[r.char_start : r.char_end] == r.term for r in rows)


def test_index(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.2]), ("c", [0.0, 3.0]), ("d", None), ("z", [0.0, 0.0])], "id string, embedding array<float>")
    index = knn.build_index(df)
    assert index.count() == 4 and knn.checked(index) is index
    with pytest.raises(ValueError):
        knn.add(index, index.limit(1))
    got = [(r.id, r.neighbor) for r in knn.top_k(index, index, 1, 0.5).orderBy("id").collect()]
    assert got == [("a", "b"), ("b", "a")]
    assert [r.id for r in knn.search(index, [1.0, 0.0], 2, exclude=["a"]).collect()] == ["b", "c"]
    assert [r.id for r in knn.search_by_id(index, "a", 1).collect()] == ["b"]
    with pytest.raises(ValueError):
        knn.search_by_id(index, "nobody")
    assert [(r.id_a, r.id_b) for r in knn.candidate_pairs(knn.top_k(index, index, 1, 0.5)).collect()] == [("a", "b")]


def test_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("b", "a"), ("x", "x"), (None, "a")] + [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)], "a string, b string")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert {got[x] for x in "abc"} == {"a"} and got["e"] == "d" and "x" not in got
    assert {v for k, v in got.items() if k.startswith("n")} == {"n000"}
    assert connected_components(edges.limit(0)).count() == 0


def test_canaries(spark):
    pairs = spark.createDataFrame([(i, str(i), str(i + 1), "x", "y") for i in range(25)], "pair_id long, id_a string, id_b string, text_a string, text_b string")
    batched = judge.assign_batches(pairs)
    checker = judge.SanityChecker()
    injected = checker.inject(batched)
    assert injected.where("is_canary").count() == 3
    right = injected.select("pair_id", F.coalesce("expected_similar", F.lit(False)).alias("is_similar"), F.lit(0.9).alias("confidence"))
    assert checker.validate(injected, right).count() == 25
    assert checker.stats(injected, right).first().asDict() == {"total_checks": 3, "passed": 3, "failed": 0, "skipped": 0, "pass_rate": 1.0}
    wrong = right.withColumn("is_similar", ~F.col("is_similar"))
    with pytest.raises(judge.SanityCheckError) as e:
        checker.validate(injected, wrong)
    assert sum(r["times"] for r in e.value.failed) == 3
    assert judge.SanityChecker("warn").validate(injected, wrong).count() == 25
    never = judge.SanityChecker("sample", sample_rate=0.0)
    assert never.stats(never.inject(batched), right).first().pass_rate == 1.0
    assert judge.SanityChecker(canaries=(("p", "q", True),)).add(("r", "s", False)).table(spark).count() == 2


def test_judges(spark):
    pairs = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.8)], "pair_id long, score double")
    assert [r.pair_id for r in judge.accepted(pairs, judge.RuleJudge(0.7).verdicts(pairs), 0.6).orderBy("pair_id").collect()] == [1, 3]
    recorded = judge.RecordedJudge(spark.createDataFrame([(2, True, 0.9)], judge.VERDICT))
    assert [r.pair_id for r in judge.accepted(pairs, recorded.verdicts(pairs), 0.6).collect()] == [2]

    def fails(frame: pd.DataFrame) -> pd.DataFrame:
        raise RuntimeError("no answer")

    assert judge.CallableJudge(fails, 1, "drop").verdicts(pairs).count() == 0
    with pytest.raises(Exception, match="no answer"):
        judge.CallableJudge(fails, 1).verdicts(pairs).collect()
    terms = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "term string, batch_id long")
    said = spark.createDataFrame([("a", True)], "term string, is_valid_entity boolean")
    failed = spark.createDataFrame([(1,)], "batch_id long")
    assert {r.term: r.is_valid_entity for r in judge.validate_entities(terms, said, failed).collect()} == {"a": True, "b": False, "c": True}


def test_verification_and_labels(spark):
    import uuid

    members = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")], "node string, root string")
    verdicts = spark.createDataFrame([("a", False, ["a", "zz"], ""), ("d", True, ["e"], ""), ("unknown", False, ["b"], "")], schemas.CLUSTER_VERDICT)
    verified = C.verify_members(members, verdicts)
    assert {r.node: r.root for r in verified.collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    docs = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    got = {r.id: r.cluster_id for r in C.label(docs, verified).collect()}
    name = lambda x: f"cluster_{uuid.uuid5(uuid.NAMESPACE_DNS, x)}"
    assert got == {"a": "cluster_a", "b": name("a"), "c": name("a"), "d": name("d"), "e": name("d"), "f": "cluster_f"}


def test_cluster_end_to_end(spark):
    rows = [{"id": "1", "text": "number of active customers"}, {"id": "2", "text": "active customers number", "other": 1}, {"id": "3", "text": "warehouse inventory report"}]
    docs = io.documents_from_dicts(spark, rows)
    got = {r.id: r.cluster_id for r in C.cluster(docs, HashingEmbedding(), config=C.ClusterConfig.from_config({"similarity_threshold": 0.9, "sanity_mode": "warn", "unknown": 1})).collect()}
    assert got["1"] == got["2"] != got["3"]
    with pytest.raises(ValueError):
        io.documents_from_dicts(spark, [rows[0], rows[0]])
    with pytest.raises(ValueError):
        io.documents_from_dicts(spark, [{"id": "1"}])


def test_similarity_of_pairs(spark):
    pairs = spark.createDataFrame([(1, "active customers number", "number active customers"), (2, "active customers", "warehouse report"), (3, None, "a b")], "pair_id long, text_a string, text_b string")
    got = {r.pair_id: r.score for r in score_pairs(pairs, HashingEmbedding()).collect()}
    assert got[1] > 0.95 and got[2] < 0.3 and got[3] is None
    topics = spark.createDataFrame([("customer", "c"), ("report", "r")], "term string, topic_id string")
    with_topics = {r.pair_id: r.score for r in score_pairs(pairs, HashingEmbedding(), topics, BlendConfig(method="jaccard")).collect()}
    assert with_topics[1] > 0.95 and with_topics[2] < 0.3
    assert BlendConfig(0, 0).weights(False) == (0.5, 0.5, 0.0)


def test_providers(spark):
    docs = spark.createDataFrame([("a", "x y", None), ("b", "z w", [9.0])], "id string, text string, embedding array<float>")
    calls = CallableEmbedding(lambda texts: [[float(len(t))] for t in texts], 2)
    assert {r.id: list(r.embedding) for r in embed_missing(docs, calls).collect()} == {"a": [3.0], "b": [9.0]}
    table = TableEmbedding(docs.where("embedding is not null"), "id")
    assert table.embed(docs.drop("embedding")).where("embedding is null").count() == 1


def test_taxonomy(spark, units, tmp_path):
    topics, term_topic, stats = taxonomy.build(units, HashingEmbedding(), config=taxonomy.TaxonomyConfig(similarity_threshold=0.4, min_confidence=0.01), strict=True)
    topics, term_topic = topics.cache(), term_topic.cache()
    assert topics.count() > 0 and stats.first().topics_created == topics.count()
    assert all(len(r.terms) > 1 and r.canonical_name == r.terms[0].title() for r in topics.collect())
    io.save_taxonomy(topics, term_topic, str(tmp_path / "t"), stats)
    back = io.load_taxonomy(spark, str(tmp_path / "t")).first()
    assert len(back.topics) == topics.count() and back.term_to_topic == {r.term: r.topic_id for r in term_topic.collect()}
    assert io.format_taxonomy(topics).count("\n") == topics.count() - 1
    with pytest.raises(ValueError):
        io.save_taxonomy(None, None, "x")
    with pytest.raises(ValueError):
        taxonomy.build(units.limit(0), HashingEmbedding(), strict=True)


def test_hierarchy(spark):
    terms = spark.createDataFrame([("milk", [1.0, 0.0]), ("kefir", [0.0, 1.0])], "term string, embedding array<float>")
    clusters = spark.createDataFrame([("c1", ["milk", "kefir"], [], "Fermented")], schemas.TERM_CLUSTER)
    items = spark.createDataFrame([("i1", None, 0, "Dairy", "all", ["milk"]), ("i2", "i1", 0, "Fermented", "some", []), ("i3", None, 1, "Later", "", ["kefir"]), ("i4", "i5", 0, "Loop", "", []), ("i5", "i4", 0, "Loop", "", [])], schemas.HIERARCHY)
    topics, term_topic = taxonomy.hierarchical_taxonomy(items, clusters, terms)
    by = {r.canonical_name: r for r in topics.collect()}
    assert set(by) == {"Dairy", "Fermented", "Later"}
    assert by["Dairy"].children == [by["Fermented"].id] and by["Fermented"].parent_topic_id == by["Dairy"].id
    assert by["Fermented"].terms == ["milk", "kefir"] and by["Fermented"].embedding == [0.5, 0.5]
    owner = {r.term: r.topic_id for r in term_topic.collect()}
    assert owner == {"milk": by["Dairy"].id, "kefir": by["Later"].id}
    paths = {r.path[-1]: r.path for r in taxonomy.topic_paths(topics).collect()}
    assert paths["Fermented"] == ["Dairy", "Fermented"]
    found = taxonomy.topic_by_term(spark.createDataFrame([("milk",), ("Milk",)], "term string"), term_topic, topics)
    assert {r.term: r.canonical_name for r in found.collect()} == {"milk": "Dairy", "Milk": None}


def test_files(spark, tmp_path):
    with pytest.raises(ValueError):
        io.read_text_files(spark, str(tmp_path / "missing"))
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "a.txt").write_text("one\ntwo")
    assert io.read_text_files(spark, str(tmp_path)).first().text == "one\ntwo"
    (tmp_path / "b.txt").write_text("top")
    assert [r.source for r in io.read_text_files(spark, str(tmp_path)).collect()] == ["b.txt"]
    docs = io.documents_from_dicts(spark, [{"id": "1", "text": "t", "embedding": [1.0]}])
    io.save_clusters(docs, docs.selectExpr("count(*) n"), str(tmp_path / "out"))
    assert io.load_clusters(spark, str(tmp_path / "out")).first().embedding == [1.0]


def test_schemas(spark):
    assert schemas.json_schema("a string, b array<int>")["required"] == ["a", "b"]
    ok = spark.createDataFrame([(0.5,), (None,)], "confidence double")
    assert schemas.within(ok, "confidence", 0, 1).count() == 2
    for bad in (1.5, -0.1):
        with pytest.raises(Exception, match="outside"):
            schemas.within(spark.createDataFrame([(bad,)], "confidence double"), "confidence", 0, 1).collect()


def test_strict_canaries_fail_with_the_rule_judge(spark):
    rows = [{"id": str(i), "text": t} for i, t in enumerate(["number of active customers", "active customers number", "warehouse inventory report"])]
    docs = io.documents_from_dicts(spark, rows)
    loose = C.ClusterConfig(similarity_threshold=0.9)
    with pytest.raises(judge.SanityCheckError) as e:  # hashed embeddings don't know that these say the same
        C.cluster(docs, HashingEmbedding(), config=loose)
    assert sum(r["times"] for r in e.value.failed) == 1
    assert C.cluster(docs, HashingEmbedding(), config=C.ClusterConfig(similarity_threshold=0.9, sanity_mode="warn")).count() == 3
    known = judge.SanityChecker("strict", (("red fox", "fox red", True),))
    got = {r.id: r.cluster_id for r in C.cluster(docs, HashingEmbedding(), config=loose, checker=known).collect()}
    assert got["0"] == got["1"] != got["2"]


def test_a_canary_without_a_verdict_has_failed(spark):
    batched = judge.assign_batches(spark.range(20_000).selectExpr("id pair_id", "'a' id_a", "'b' id_b", "'x' text_a", "'y' text_b"))
    checker = judge.SanityChecker()
    injected = checker.inject(batched)
    with pytest.raises(judge.SanityCheckError, match="2000 canaries failed") as e:
        checker.validate(injected, injected.where("not is_canary").selectExpr("pair_id", "true is_similar", "1.0D confidence"))
    assert len(e.value.failed) == 5 and sum(r["times"] for r in e.value.failed) == 2000


def test_each_text_is_embedded_and_each_pair_judged_once(spark, tmp_path):
    import os

    def note(kind, n):
        with open(tmp_path / f"{kind}-{os.getpid()}-{os.urandom(4).hex()}", "w") as f:
            f.write(str(n))

    total = lambda kind: sum(int(p.read_text()) for p in tmp_path.glob(f"{kind}-*"))

    def embed(texts):
        note("embed", len(texts))
        return [[1.0, float(len(t) % 3), 0.5] for t in texts]

    def say(frame: pd.DataFrame) -> pd.DataFrame:
        note("judge", len(frame))
        return frame.assign(is_similar=frame.score > 0.99, confidence=0.9)

    docs = io.documents_from_dicts(spark, [{"id": str(i), "text": "x" * (i + 1)} for i in range(9)])
    known = judge.SanityChecker("strict", (("abc", "xyz", True),))
    got = C.cluster(docs, CallableEmbedding(embed, 2), judge.CallableJudge(say, 2), C.ClusterConfig(similarity_threshold=0.3), checker=known).collect()
    assert len({r.cluster_id for r in got}) == 3
    pairs = 9 * 8 // 2
    assert total("embed") == 9 + 2 and total("judge") == pairs + -(-pairs // 10)
    with pytest.raises(ValueError, match="repeat"):
        C.cluster(docs.union(docs), HashingEmbedding(), checker=known)
    with pytest.raises(Exception, match="empty text"):
        C.cluster(io.documents_from_dicts(spark, [{"id": "1", "text": " \n "}]), HashingEmbedding()).collect()


def test_verifiers_see_whole_clusters(spark):
    docs = io.documents_from_dicts(spark, [{"id": i, "text": t} for i, t in (("a", "red fox"), ("b", "fox red"), ("c", "red fox fox"), ("d", "blue whale"))])

    def check(clusters):
        assert [(c["cluster_id"], [m["id"] for m in c["members"]]) for c in clusters] == [("a", ["a", "b", "c"])]
        return [{"cluster_id": "a", "is_valid": False, "members_to_remove": ["c"]}]

    config = C.ClusterConfig(similarity_threshold=0.9, sanity_mode="off")
    got = {r.id: r.cluster_id for r in C.cluster(docs, HashingEmbedding(), config=config, verify=C.CallableVerifier(check)).collect()}
    assert got["a"] == got["b"] and len(set(got.values())) == 3


def test_chat_judge(spark):
    import json

    pairs = spark.createDataFrame([(1, "red fox", "fox red", 0), (2, "red fox", "blue whale", 0), (3, "a", "b", 1)], "pair_id long, text_a string, text_b string, batch_id long")

    def chat(system, prompt, schema):
        assert "JSON" not in prompt and schema["required"] == ["pairs"] and "Pair " in prompt and system
        if "Pair 3" in prompt:
            return "no JSON"
        return json.dumps({"pairs": [{"pair_id": 1, "is_similar": True, "confidence": 0.9, "reasoning": ""}, {"pair_id": 77, "is_similar": True, "confidence": 1, "reasoning": ""}]})

    said = judge.ChatJudge(chat, on_error="drop").verdicts(pairs).collect()
    assert [(r.pair_id, r.is_similar) for r in said] == [(1, True)]
    with pytest.raises(Exception, match="Expecting value"):
        judge.ChatJudge(chat).verdicts(pairs).collect()
    for bad in ("{}", '{"pairs": [{"pair_id": 1, "is_similar": 1, "confidence": 0.5}]}', '{"pairs": [{"pair_id": 1, "is_similar": true, "confidence": 1.5}]}'):
        with pytest.raises(ValueError):
            judge.parse_answer(bad)


def test_deep_hierarchies_and_cycles(spark):
    n = 130
    items = spark.createDataFrame([(f"i{k:03}", f"i{k - 1:03}" if k else None, 0, f"N{k}", "", [f"t{k}", "shared"]) for k in range(n)] + [("x", "y", 0, "X", "", ["x"]), ("y", "x", 0, "Y", "", []), ("z", "gone", 0, "Z", "", [])], schemas.HIERARCHY)
    order = {r.item_id: r.depth for r in taxonomy.hierarchy_order(items).collect()}
    assert order == {f"i{k:03}": k for k in range(n)}
    topics = items.select(F.col("item_id").alias("id"), F.col("name").alias("canonical_name"), F.col("parent_id").alias("parent_topic_id"))
    paths = {r.id: r.path for r in taxonomy.topic_paths(topics).collect()}
    assert paths["i129"] == [f"N{k}" for k in range(n)] and paths["z"] == ["Z"]
    assert paths["x"] == ["Y", "X"] and paths["y"] == ["X", "Y"]


def test_columns_of_the_callers_own_names(spark):
    docs = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "id string, _label int, _verdict int")
    members = spark.createDataFrame([("a", "a"), ("b", "a")], "node string, root string")
    assert C.label(docs, members).columns == ["id", "_label", "_verdict", "cluster_id"]
    terms = docs.withColumnRenamed("id", "term").withColumn("_failed", F.lit(1)).withColumn("batch_id", F.lit(0))
    said = spark.createDataFrame([("a", True)], "term string, is_valid_entity boolean")
    got = judge.validate_entities(terms, said, spark.createDataFrame([(5,)], "batch_id int"))
    assert {"_label", "_verdict", "_failed"} <= set(got.columns) and {r.term: r.is_valid_entity for r in got.collect()} == {"a": True, "b": False}


def test_grams_are_those_of_the_plain_list(spark):
    import random

    import pyarrow as pa

    rng = random.Random(3)
    words = ["the", "of", "and", "milk", "ox", "cheese", "whole", "a", "butter"]
    lists = [[rng.choice(words) for _ in range(rng.randint(0, 9))] for _ in range(60)] + [None, []]
    g = tfidf.Grams(pa.array(lists, pa.list_(pa.string())))
    got = Counter(zip(g.unit.tolist(), g.texts(g.key).to_pylist(), strict=True))
    assert got == Counter((i, x) for i, own in enumerate(lists) for x in tfidf.ngrams(own or []))
    assert g.texts(g.keys([["whole", "milk"], ["unknown"], ["milk"]])).to_pylist() == ["milk", "whole milk"]
    units = spark.createDataFrame([("s", 0, i, " ".join(own or [])) for i, own in enumerate(lists)], "source string, ord long, unit_no int, text string")
    terms = spark.createDataFrame([("whole milk",), ("cheese",)], "term string")
    few = sorted(map(tuple, tfidf.term_contexts(units, terms).collect()))
    tfidf.LOOKED_FOR, before = 1, tfidf.LOOKED_FOR
    try:
        assert sorted(map(tuple, tfidf.term_contexts(units, terms).collect())) == few and few
    finally:
        tfidf.LOOKED_FOR = before


def test_neighbours_over_many_shares(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (40, 4)).astype(float)
    index = knn.build_index(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>"))
    want = {(r.id, r.neighbor, r.score, r.rank) for r in knn.top_k(index, index, 3, 0.1).collect()}
    monkeypatch.setattr(knn, "CELL", 30)
    assert {(r.id, r.neighbor, r.score, r.rank) for r in knn.top_k(index, index, 3, 0.1).collect()} == want
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(norm > 0, norm, 1)
    s = np.round(u @ u.T, 9)
    for i in range(40):
        best = sorted((j for j in range(40) if j != i and s[i, j] >= 0.1), key=lambda j: (-s[i, j], j))[:3]
        assert [b for a, b, _, r in sorted(want, key=lambda z: z[3]) if a == i] == best


def test_topics_over_many_automata(spark, monkeypatch):
    from textloom.operators import similarity

    texts = spark.createDataFrame([(1, "The cat sat"), (2, "concatenate DOGS"), (3, None), (4, "")], "id long, text string")
    topics = spark.createDataFrame([("cat", "c"), ("CAT", "k"), ("dog", "d"), (None, "n"), ("at sat", "s")], "term string, topic_id string")
    want = {1: ["c", "k", "s"], 2: ["c", "d", "k"], 3: [], 4: []}
    for size in (200_000, 2):
        monkeypatch.setattr(similarity, "LOOKED_FOR", size)
        assert {r.id: r.topics for r in similarity.extract_topics(texts, topics, "id").collect()} == want


def test_saved_taxonomies_say_when(spark, tmp_path):
    topics = spark.createDataFrame([("t1", "T", "", ["a"], None, [], [], [])], schemas.TOPIC)
    io.save_taxonomy(topics, taxonomy.term_topics(topics), str(tmp_path / "t"))
    assert io.load_taxonomy(spark, str(tmp_path / "t")).first().created_at[:2] == "20"
    assert "T: a" in io.format_taxonomy(topics)


def test_partial_ratio_of_long_texts():
    import random
    import time

    from textloom.functions.lexical import partial_ratio

    rng = random.Random(2)
    a = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    b = "".join(rng.choice("abcdefgh ") for _ in range(2000)) + a[:1500] + "#" + a[1500:]
    began = time.time()
    assert 99.9 < partial_ratio(a, b) < 100 and time.time() - began < 20


def windows(a, b):
    """The definition, window by window."""
    from functools import lru_cache

    short, long_ = sorted((a, b), key=len)

    def common(x, y):
        @lru_cache(None)
        def f(i, j):
            return 0 if i == len(x) or j == len(y) else f(i + 1, j + 1) + 1 if x[i] == y[j] else max(f(i + 1, j), f(i, j + 1))

        return f(0, 0)

    def best(s, t):
        return max((200 * common(s, w) / (len(s) + len(w)) for i in range(1 - len(s), len(t)) for w in [t[max(0, i) : i + len(s)]]), default=0)

    return 0 if not short else max(best(short, long_), best(long_, short)) if len(short) == len(long_) else best(short, long_)


def test_partial_ratio_is_the_best_window():
    import random

    from textloom.functions.lexical import partial_ratio

    rng = random.Random(7)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randint(0, 8))) for _ in range(2))
        assert partial_ratio(a, b) == pytest.approx(windows(a, b))


def test_command_line(spark, tmp_path):
    from textloom.__main__ import main

    assert "rye bread" in main(["taxonomy"]).lower()
    (tmp_path / "a.txt").write_text("Rye bread keeps.\nRye bread sells.\nFresh rye bread.\nNothing else here.")
    assert main(["cluster"]).count("(2)") >= 2
    with pytest.raises(ValueError):
        main(["taxonomy", str(tmp_path / "nowhere")])


def test_equal_vectors_are_compared_once(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    kinds = [[1, 1, 0, 0], [1, 1, 0, 0.0], [1, 0.9, 0, 0], [0, 0, 1, 1], [0, 0, 0, 0], [2, 2, 0, 0], [1, 0, 1, 0], [0, 1, 0, 1]]
    x = np.array([kinds[i] for i in rng.integers(0, len(kinds), 120)], float)
    names = [str(n) for n in rng.permutation(120)]  # ordered as texts
    index = knn.build_index(spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, x)], "id string, embedding array<double>"))
    dealt, compared = [], knn._compared
    monkeypatch.setattr(knn, "_compared", lambda q, i, *a: dealt.append((q.count(), i.count())) or compared(q, i, *a))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(norm > 0, norm, 1)
    s = np.round(u @ u.T, 9)
    for asked, threshold, own in ((index, 0.5, True), (index, None, True), (index, 0.9, False), (index.where("id % 5 = 0"), 0.3, True)):
        got = sorted((r.id, r["rank"], r.neighbor, r.score) for r in knn.top_k(asked, index, 4, threshold, own).collect())
        ids = {r.id for r in asked.collect()}
        want = []
        for i, n in enumerate(names):
            best = sorted(((-s[i, j], m) for j, m in enumerate(names) if not (own and i == j) and s[i, j] >= (-2 if threshold is None else threshold)))[:4]
            want += [(n, r + 1, m, -d) for r, (d, m) in enumerate(best)] if n in ids else []
        assert got == sorted(want) and len(want) > 20
    assert all(q <= len(kinds) and i <= len(kinds) for q, i in dealt) and len(dealt) == 4


def test_a_comparison_holds_few_scores_at_once():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(5)
    y = rng.normal(size=(20_000, 16))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    x = y[:2500]
    y32 = y.astype(np.float32)
    tracemalloc.start()
    try:
        for floor in (0.6, -2.0):
            row, col, s = knn._nearest(x, y, y32, 5, floor)
            for i in (0, 1100, 2499):
                exact = np.round(y @ x[i], 9)
                assert col[row == i].tolist() == np.lexsort((np.arange(len(y)), -exact))[:5].tolist() and np.allclose(s[row == i], np.sort(exact)[::-1][:5])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64 << 20  # 2,048 rows of scores alone would be 328 MB


def test_dense_batches_are_slices_of_one_order(spark):
    # Of 100,000 rows and more there is more than one range.
    pairs = spark.range(0, 230_007).select(F.when(F.col("id") < 230_005, (F.col("id") * 7919 % 230_005) * 3 - 1000).alias("pair_id"), F.lit("x").alias("_mark"))
    got = judge.dense_batches(pairs).withColumn("n", F.when(F.col("pair_id").isNull(), 230_005).otherwise((F.col("pair_id") + 1000) / 3))
    assert got.count() == 230_007 and got.columns[:3] == ["pair_id", "_mark", "batch_id"]
    assert got.where("pair_id is not null and batch_id <> floor(n / 10)").count() == 0
    assert [r.batch_id for r in got.where("pair_id is null").collect()] == [23_000, 23_000]


def test_pairs_are_combed_once_and_together(monkeypatch):
    import random

    from textloom.functions import lexical

    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    pairs = [(text(rng.randint(30, 40)), text(rng.randint(41, 50))) for _ in range(150)]
    alone = [lexical.partial_ratio(*p) for p in pairs]
    combed, comb = [], lexical.semilocal_ends
    monkeypatch.setattr(lexical, "semilocal_ends", lambda own: combed.append(len(own)) or comb(own))
    found = lexical._partial(pd.Series([a for a, _ in pairs] * 20 + [None]), pd.Series([b for _, b in pairs] * 20 + ["a"]))
    assert found[:150].tolist() == [x / 100 for x in alone] and found[150:3000].tolist() == found[:150].tolist() * 19 and math.isnan(found[3000])
    assert sum(combed) <= 150 and len(combed) < 10
