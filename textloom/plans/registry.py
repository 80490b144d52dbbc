"""All queries of the library by name, each over whole tables, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import vector as V
from textloom.functions.lexical import syntactic_similarity
from textloom.functions.words import LEXICAL_STOP_WORDS, TERM_STOP_WORDS
from textloom.operators import cluster as C
from textloom.operators import knn, taxonomy, tfidf
from textloom.operators.graph import connected_components
from textloom.operators.judge import RecordedJudge, RuleJudge, SanityChecker, accepted, assign_batches, dense_batches, validate_entities
from textloom.operators.similarity import BlendConfig, blend, extract_topics, score_pairs
from textloom.providers import HashingEmbedding, embed_missing
from textloom.sources.io import clusters_for_display, corpus_units, dealt, documents_from_dicts, from_texts, load_clusters, load_taxonomy, read_text_files, save_clusters, save_taxonomy, spread
from textloom.sources.shared import scratch, store

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

TOPICS = [("tion", "suffix"), ("ment", "suffix"), ("heit", "suffix"), ("the", "article"), ("der ", "article"), ("les ", "article"), ("los", "article"), ("QUE", "link"), ("und", "link"), ("nowhere at all", "none")]
#: Cosines of the tables' embeddings seldom pass 0.5.
NEAR = 0.35


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(_t(spark, sf_dir, "documents")).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source"), "text", "doc_id")
    return corpus_units(docs, order="doc_id")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.build_index(_t(spark, sf_dir, "embeddings"), "vec_id")


def _term_topic(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOPICS, "term string, topic_id string")


# SQL fragments. DuckDB's \b and \w are ASCII, so words are split, then matched whole.
def _in(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"


def _tok(x: str) -> str:
    return rf"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '[a-z][a-z0-9]*'))"


def _norm(x: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda t: length(t) > 1 AND NOT list_contains({_in(LEXICAL_STOP_WORDS)}, t))"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {_strip('l')}), lambda l: l <> '')"


def _sentences(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda l: {_strip('l')}), lambda l: length(l) > 10)"


_SPLIT = f"SELECT doc_id, {_lines('text')} a, {_sentences('text')} b FROM documents"
_ALL_UNITS = f"SELECT doc_id, unnest(u) AS unit, generate_subscripts(u, 1) - 1 AS unit_no FROM (SELECT doc_id, CASE WHEN len(a) < 5 AND len(b) > len(a) THEN b ELSE a END u FROM ({_SPLIT}))"
_UNIT_CTE = f"units AS (SELECT * FROM ({_ALL_UNITS}) WHERE length(unit) > 10)"
_GRAM_CTE = f"""tokens AS (SELECT doc_id, unit_no, {_tok('unit')} t FROM units),
places AS (SELECT *, unnest(range(1, len(t) + 1)) i FROM tokens),
marked AS (SELECT doc_id, unit_no, i, t[i] a, t[i + 1] b, t[i + 2] c FROM places),
stops AS (SELECT unnest({_in(TERM_STOP_WORDS)}) w),
flags AS (SELECT m.*, a IN (FROM stops) sa, b IN (FROM stops) sb, c IN (FROM stops) sc FROM marked m),
grams AS (SELECT doc_id, unit_no, a AS term, 1 k FROM flags WHERE NOT sa AND length(a) > 2
UNION ALL SELECT doc_id, unit_no, a || ' ' || b, 2 FROM flags WHERE b IS NOT NULL AND NOT (sa AND sb)
UNION ALL SELECT doc_id, unit_no, a || ' ' || b || ' ' || c, 3 FROM flags WHERE c IS NOT NULL AND NOT (sa AND sb AND sc)),
sizes AS (SELECT doc_id, unit_no, count(*) n FROM grams GROUP BY ALL),
tf AS (SELECT doc_id, unit_no, term, k, count(*) c FROM grams GROUP BY ALL),
terms AS (SELECT term, k, count(*) df, max(c / n) max_tf FROM tf JOIN sizes USING (doc_id, unit_no) GROUP BY ALL),
total AS (SELECT count(*) n FROM units),
scored AS (SELECT term, ['unigram', 'bigram', 'trigram'][k] term_type, round(max_tf * ln(n / df), 9) tfidf, df FROM terms, total WHERE df BETWEEN 2 AND floor(n * 0.8))"""


@query(f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {_tok('text')} t FROM documents)")
def tokenize_docs(spark, d):
    t = T.tokenize(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query(f"SELECT doc_id, array_to_string({_norm('text')}, ' ') AS tokens FROM documents")
def normalized_tokens(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(T.normalize_tokens(F.col("text")), " ").alias("tokens"))


@query(f"WITH {_UNIT_CTE} SELECT 'doc' || doc_id || ':line' || (unit_no + 1) AS source, unit FROM units")
def sentence_units(spark, d):
    return _units(spark, d).select("source", F.col("text").alias("unit"))


@query(f"SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS n FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: lower({_strip('l')})), lambda l: length(l) > 10) s FROM documents)")
def line_sentences(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.posexplode(T.line_sentences(F.col("text"))).alias("n", "sentence")).select("doc_id", "sentence", F.col("n").cast("long").alias("n"))


@query(f"WITH {_UNIT_CTE}, {_GRAM_CTE} SELECT term, df FROM terms WHERE df >= 2")
def ngram_df(spark, d):
    return tfidf.term_statistics(_units(spark, d)).where("df >= 2").select("term", "df")


@query(f"WITH {_UNIT_CTE}, {_GRAM_CTE} SELECT term, term_type, tfidf, df FROM scored ORDER BY tfidf DESC, term LIMIT 200")
def tfidf_top_terms(spark, d):
    return tfidf.extract_terms(_units(spark, d), tfidf.TermConfig(top_n=200))


@query(f"WITH {_UNIT_CTE}, {_GRAM_CTE}, top AS (SELECT * FROM scored ORDER BY tfidf DESC, term LIMIT 5000) SELECT term_type, count(*) AS n FROM top GROUP BY 1")
def term_type_histogram(spark, d):
    return tfidf.extract_terms(_units(spark, d)).groupBy("term_type").agg(F.count("*").alias("n"))


@query(f"WITH {_UNIT_CTE}, {_GRAM_CTE} SELECT (SELECT n FROM total) AS documents, (SELECT sum(len(t))::BIGINT FROM tokens) AS tokens, count_if(k = 1)::BIGINT AS unigrams, count_if(k = 2)::BIGINT AS bigrams, count_if(k = 3)::BIGINT AS trigrams, 0 AS terms_extracted FROM terms")
def corpus_stats(spark, d):
    return tfidf.corpus_statistics(_units(spark, d))


@query(f"""WITH {_UNIT_CTE}, {_GRAM_CTE}, top AS (SELECT term FROM scored ORDER BY tfidf DESC, term LIMIT 50),
lines AS (SELECT doc_id, unit_no, unnest(s) AS sentence, generate_subscripts(s, 1) AS line_no FROM (SELECT doc_id, unit_no, list_filter(list_transform(string_split(unit, chr(10)), lambda l: lower({_strip('l')})), lambda l: length(l) > 10) s FROM units)),
has AS (SELECT DISTINCT doc_id, unit_no, term FROM grams WHERE term IN (FROM top)),
hits AS (SELECT term, doc_id, unit_no, sentence, row_number() OVER (PARTITION BY term ORDER BY doc_id, unit_no, line_no) nth FROM has JOIN lines USING (doc_id, unit_no) WHERE instr(sentence, term) > 0)
SELECT term, nth, sentence, 'doc' || doc_id || ':line' || (unit_no + 1) AS source, instr(sentence, term) - 1 AS char_start, instr(sentence, term) - 1 + length(term) AS char_end FROM hits WHERE nth <= 5""")
def term_contexts(spark, d):
    units = _units(spark, d)
    return tfidf.term_contexts(units, store(tfidf.extract_terms(units, tfidf.TermConfig(top_n=50)), "extracted-terms"))


_E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) v, label FROM embeddings)"
_NEXT = f"{_E}, p AS (SELECT a.vec_id vec_a, b.vec_id vec_b, a.v va, b.v vb FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"


def _knn_sql(k: int, threshold: float, asked: str = "true") -> str:
    return f"{_E}, s AS (SELECT a.vec_id id, b.vec_id neighbor, round(list_cosine_similarity(a.v, b.v), 9) score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE {asked}), nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbor) AS rank FROM s WHERE score >= {threshold} QUALIFY rank <= {k})"


def _next_vectors(spark, d) -> DataFrame:
    e = _t(spark, d, "embeddings")
    a = e.select(F.col("vec_id").alias("vec_a"), F.col("embedding").alias("va"), (F.col("vec_id") + 1).alias("vec_b"))
    return a.join(e.select(F.col("vec_id").alias("vec_b"), F.col("embedding").alias("vb")), "vec_b")


@query(f"WITH {_E} SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_dot_product(v, v) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(v, v)), 6) AS unit_norm FROM e")
def unit_vectors_norm(spark, d):
    unit = V.norm(V.l2_normalize(F.col("embedding")))
    return _t(spark, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(unit, 6).alias("unit_norm"))


@query(f"WITH {_NEXT} SELECT vec_a, vec_b, round(list_cosine_similarity(va, vb), 6) AS cosine FROM p")
def cosine_pairs(spark, d):
    return _next_vectors(spark, d).select("vec_a", "vec_b", F.round(V.cosine_similarity(F.col("va"), F.col("vb")), 6).alias("cosine"))


@query(f"WITH {_NEXT} SELECT vec_a, vec_b, round(1 / (1 + exp(-15.0 * (list_cosine_similarity(va, vb) - 0.3))), 6) AS score FROM p")
def calibrated_from_embeddings(spark, d):
    return _next_vectors(spark, d).select("vec_a", "vec_b", F.round(V.similarity_from_embeddings(F.col("va"), F.col("vb"), 0.3), 6).alias("score"))


#: A search's queries: the rows whose id is divisible by 100, against all rows.
_ASKED = "a.vec_id % 100 = 0"


@query(f"WITH {_knn_sql(5, -2, _ASKED)} SELECT id, neighbor, round(score, 6) AS score, rank FROM nn")
def knn_topk(spark, d):
    index = _index(spark, d)
    return knn.top_k(index.where("id % 100 = 0"), index, 5).select("id", "neighbor", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_knn_sql(20, NEAR, _ASKED)} SELECT id, neighbor, round(score, 6) AS score, rank FROM nn")
def knn_threshold(spark, d):
    index = _index(spark, d)
    return knn.top_k(index.where("id % 100 = 0"), index, 20, NEAR).select("id", "neighbor", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_CANDIDATES = f"{_knn_sql(10, NEAR)}, c AS (SELECT id id_a, neighbor id_b, score FROM nn QUALIFY row_number() OVER (PARTITION BY least(id, neighbor), greatest(id, neighbor) ORDER BY id, rank) = 1)"


def _candidates(spark, d) -> DataFrame:
    index = knn.build_index(spread(_t(spark, d, "embeddings")), "vec_id")
    return knn.candidate_pairs(knn.top_k(index, index, 10, NEAR))


@query(f"WITH {_CANDIDATES} SELECT id_a, id_b, round(score, 6) AS score FROM c")
def candidate_pairs(spark, d):
    return _candidates(spark, d).withColumn("score", F.round("score", 6))


@query(f"WITH {_E} SELECT vec_id AS id, round(list_cosine_similarity(v, (SELECT v FROM e WHERE vec_id = 0)), 6) AS score FROM e WHERE vec_id NOT IN (0, 1, 2) ORDER BY round(list_cosine_similarity(v, (SELECT v FROM e WHERE vec_id = 0)), 9) DESC, vec_id LIMIT 10")
def search_exclude(spark, d):
    index = _index(spark, d)
    unit = index.where("id = 0").select("unit").first()
    return knn.search(index, list(unit.unit), 10, None, [0, 1, 2]).withColumn("score", F.round("score", 6))


_TURNS = "t AS (SELECT a.conv_id, a.turn, a.text text_a, b.text text_b FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"


def _turns(spark, d) -> DataFrame:
    c = _t(spark, d, "conversations")
    return c.select("conv_id", "turn", F.col("text").alias("text_a"), (F.col("turn") + 1).alias("_next")).join(c.select("conv_id", F.col("turn").alias("_next"), F.col("text").alias("text_b")), ["conv_id", "_next"])


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END"


@query(f"WITH {_TURNS}, x AS (SELECT conv_id, turn, list_distinct({_norm('text_a')}) a, list_distinct({_norm('text_b')}) b FROM t) SELECT conv_id, turn, round({_jaccard('a', 'b')}, 6) AS score FROM x")
def lexical_jaccard(spark, d):
    return _turns(spark, d).select("conv_id", "turn", F.round(syntactic_similarity(F.col("text_a"), F.col("text_b"), "jaccard"), 6).alias("score"))


_LCS = """n AS (SELECT p_partkey k, array_to_string(list_sort(list_distinct(%s)), ' ') s FROM part),
both_ AS (SELECT a.k a, b.k b, a.s x, b.s y FROM n a JOIN n b ON b.k = a.k + 1),
sides AS (SELECT a, b, x s, y l FROM both_ WHERE length(x) <= length(y) UNION ALL SELECT a, b, y, x FROM both_ WHERE length(y) <= length(x)),
w AS (SELECT a, b, s, string_split(s, '') sc, substr(l, greatest(i, 0) + 1, length(s) + least(i, 0)) win FROM (SELECT *, unnest(range(1 - length(s), length(l))) i FROM sides WHERE s <> '')),
r(s, sc, win, i, line) AS (SELECT DISTINCT s, sc, win, 0, list_transform(range(0, length(s) + 1), lambda j: 0) FROM w
UNION ALL SELECT s, sc, win, i + 1, list_concat([0], list_transform(range(1, length(s) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda h: greatest(line[h + 1], line[h] + CASE WHEN sc[h] = substr(win, i + 1, 1) THEN 1 ELSE 0 END))))) FROM r WHERE i < length(win)),
best AS (SELECT a, b, max(2 * list_max(line) / (length(s) + length(win))) m FROM w JOIN r USING (s, win) WHERE r.i = length(win) GROUP BY ALL)""" % _norm("p_name")


@query(f"WITH RECURSIVE {_LCS} SELECT a, b, round(coalesce(m, 0), 6) AS score FROM both_ LEFT JOIN best USING (a, b)")
def lexical_partial_ratio(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("a"), F.col("p_name").alias("text_a"), (F.col("p_partkey") + 1).alias("b"))
    q = _t(spark, d, "part").select(F.col("p_partkey").alias("b"), F.col("p_name").alias("text_b"))
    return dealt(p.join(q, "b")).select("a", "b", F.round(syntactic_similarity(F.col("text_a"), F.col("text_b")), 6).alias("score"))


_TOPIC_SQL = "tt(term, topic_id) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in TOPICS) + "), dt AS (SELECT doc_id, coalesce(list_sort(list_distinct(list(topic_id) FILTER (topic_id IS NOT NULL))), []) topics FROM documents LEFT JOIN tt ON instr(lower(text), lower(term)) > 0 GROUP BY doc_id)"


@query(f"WITH {_TOPIC_SQL} SELECT doc_id, array_to_string(topics, ',') AS topics FROM dt")
def topic_extract(spark, d):
    return extract_topics(_t(spark, d, "documents"), _term_topic(spark), "doc_id").select("doc_id", F.array_join("topics", ",").alias("topics"))


def _next_docs(spark, d, with_topics: bool) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", "text")
    if with_topics:
        docs = docs.join(extract_topics(docs, _term_topic(spark), "doc_id"), "doc_id")
    a = docs.select(F.col("doc_id").alias("doc_a"), (F.col("doc_id") + 1).alias("doc_b"), *[F.col(c).alias(f"{c}_a") for c in docs.columns[1:]])
    return a.join(docs.select(F.col("doc_id").alias("doc_b"), *[F.col(c).alias(f"{c}_b") for c in docs.columns[1:]]), "doc_b")


@query(f"WITH {_TOPIC_SQL} SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, round({_jaccard('a.topics', 'b.topics')}, 6) AS score FROM dt a JOIN dt b ON b.doc_id = a.doc_id + 1")
def topic_jaccard(spark, d):
    return _next_docs(spark, d, True).select("doc_a", "doc_b", F.round(V.jaccard(F.col("topics_a"), F.col("topics_b")), 6).alias("score"))


def _hybrid_pairs(spark, d, with_topics: bool) -> DataFrame:
    e = _t(spark, d, "embeddings")
    pairs = _next_docs(spark, d, with_topics)
    for x in "ab":
        pairs = pairs.join(e.select(F.col("vec_id").alias(f"doc_{x}"), F.col("embedding").alias(f"e_{x}")), f"doc_{x}")
    return pairs


_HYBRID = f"{_TOPIC_SQL}, {_E}, w AS (SELECT doc_id, list_distinct({_norm('text')}) w FROM documents), h AS (SELECT a.doc_id doc_a, b.doc_id doc_b, list_cosine_similarity(ea.v, eb.v) c, {_jaccard('wa.w', 'wb.w')} l, {_jaccard('a.topics', 'b.topics')} t FROM dt a JOIN dt b ON b.doc_id = a.doc_id + 1 JOIN e ea ON ea.vec_id = a.doc_id JOIN e eb ON eb.vec_id = b.doc_id JOIN w wa ON wa.doc_id = a.doc_id JOIN w wb ON wb.doc_id = b.doc_id)"


@query(f"WITH {_HYBRID} SELECT doc_a, doc_b, round(1 / (1 + exp(-15.0 * (0.85 * (CASE WHEN c <= 0.65 THEN c * 0.8 ELSE c * 1.2 END) + 0.1 * l + 0.05 * t - 0.65))), 9) AS score FROM h")
def hybrid_score(spark, d):
    p = _hybrid_pairs(spark, d, True)
    score = blend(V.cosine_similarity(F.col("e_a"), F.col("e_b")), syntactic_similarity(F.col("text_a"), F.col("text_b"), "jaccard"), V.jaccard(F.col("topics_a"), F.col("topics_b")), BlendConfig(rescale=True))
    return p.select("doc_a", "doc_b", F.round(score, 9).alias("score"))


@query(f"WITH {_HYBRID} SELECT doc_a, doc_b, round(1 / (1 + exp(-15.0 * (0.85 / 0.95 * c + 0.1 / 0.95 * l - 0.65))), 9) AS score FROM h")
def hybrid_score_batch(spark, d):
    p = _hybrid_pairs(spark, d, False)
    score = blend(V.cosine_similarity(F.col("e_a"), F.col("e_b")), syntactic_similarity(F.col("text_a"), F.col("text_b"), "jaccard"))
    return p.select("doc_a", "doc_b", F.round(score, 9).alias("score"))


@query()
def hybrid_score_embedded(spark, d):
    """Turn pairs with hashed embeddings and the default lexical method, each distinct text embedded once."""
    pairs = _turns(spark, d).select(F.xxhash64("conv_id", "turn").alias("pair_id"), "text_a", "text_b")
    return score_pairs(pairs, HashingEmbedding(), _term_topic(spark), BlendConfig())


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL)")
def missing_embeddings(spark, d):
    have = _t(spark, d, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("doc_id"))
    return _t(spark, d, "documents").select("doc_id").join(have, "doc_id", "left_anti")


def _batched(spark, d) -> DataFrame:
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("pair_id"), F.col("doc_id").cast("string").alias("id_a"), (F.col("doc_id") + 1).cast("string").alias("id_b"), F.col("text").alias("text_a"), F.col("lang").alias("text_b"))
    return assign_batches(docs)


@query("SELECT doc_id // 10 AS batch_id, count(*) AS n FROM documents GROUP BY 1")
def batch_assignment(spark, d):
    return _batched(spark, d).groupBy("batch_id").agg(F.count("*").alias("n"))


_CANARY = "b AS (SELECT DISTINCT doc_id // 10 batch_id FROM documents), k AS (SELECT -(batch_id * 5 + batch_id % 5 + 1) pair_id, batch_id, batch_id % 5 canary_no FROM b)"


@query(f"WITH {_CANARY} SELECT pair_id, batch_id, '__canary_' || canary_no || '_a__' AS id_a, true AS is_canary FROM k UNION ALL SELECT doc_id, doc_id // 10, doc_id::VARCHAR, false FROM documents")
def canary_injection(spark, d):
    return SanityChecker().inject(_batched(spark, d)).select("pair_id", "batch_id", "id_a", "is_canary")


@query(f"WITH {_CANARY}, v AS (SELECT *, pair_id % 3 = 0 AS said, canary_no < 3 AS expected FROM k) SELECT count(*) AS total_checks, count_if(said = expected)::BIGINT AS passed, count_if(said <> expected)::BIGINT AS failed, 0::BIGINT AS skipped, round(count_if(said = expected) / count(*), 6) AS pass_rate FROM v")
def canary_stats(spark, d):
    checker = SanityChecker("warn")
    injected = checker.inject(_batched(spark, d))
    verdicts = injected.select("pair_id", (F.col("pair_id") % 3 == 0).alias("is_similar"))
    return checker.stats(injected, verdicts).withColumn("pass_rate", F.round("pass_rate", 6))


_EDGES = f"{_CANDIDATES}, j AS (SELECT id_a, id_b, 1 / (1 + exp(-15.0 * (score - {NEAR}))) confidence FROM c WHERE score >= 0.36), edges AS (SELECT * FROM j WHERE confidence >= 0.55)"


def _edges(spark, d) -> DataFrame:
    pairs = store(_candidates(spark, d).withColumn("pair_id", F.xxhash64("id_a", "id_b")), "candidates")
    return accepted(pairs, RuleJudge(0.36, NEAR).verdicts(pairs), 0.55)


@query(f"WITH {_EDGES} SELECT id_a, id_b, round(confidence, 6) AS confidence FROM edges")
def judged_edges(spark, d):
    return _edges(spark, d).select("id_a", "id_b", F.round("confidence", 6).alias("confidence"))


_MEMBERS = f"RECURSIVE {_EDGES}, both_ AS (SELECT id_a u, id_b w FROM edges UNION SELECT id_b, id_a FROM edges), reach(node, root) AS (SELECT u, u FROM both_ UNION SELECT w, root FROM reach JOIN both_ ON node = u), m AS (SELECT node, min(root) root FROM reach GROUP BY node)"


def _members(spark, d) -> DataFrame:
    return connected_components(_edges(spark, d), "id_a", "id_b")


@query(f"WITH {_MEMBERS} SELECT node, root FROM m")
def components(spark, d):
    return _members(spark, d)


def _uuid_sql(x: str) -> str:
    h = f"sha1('\\x6b\\xa7\\xb8\\x10\\x9d\\xad\\x11\\xd1\\x80\\xb4\\x00\\xc0\\x4f\\xd4\\x30\\xc8'::BLOB || encode({x}))"
    variant = f"substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr({h}, 17, 1)), 1)"
    return f"'cluster_' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


_LABELS = f"l AS (SELECT vec_id AS id, coalesce({_uuid_sql('root::VARCHAR')}, 'cluster_' || vec_id) AS cluster_id FROM embeddings LEFT JOIN m ON node = vec_id)"


def _labels(spark, d) -> DataFrame:
    return C.label(_t(spark, d, "embeddings").select(F.col("vec_id").alias("id")), _members(spark, d))


@query(f"WITH {_MEMBERS}, {_LABELS} SELECT id, cluster_id FROM l")
def cluster_labels(spark, d):
    return _labels(spark, d)


@query(f"WITH {_MEMBERS}, {_LABELS} SELECT count(DISTINCT cluster_id) AS cluster_count FROM l")
def cluster_count(spark, d):
    return C.cluster_count(_labels(spark, d))


@query(f"WITH {_MEMBERS}, r AS (SELECT root, max(node) node FROM m GROUP BY root HAVING count(*) > 1 AND root % 2 = 0) SELECT m.node, CASE WHEN r.node IS NOT NULL THEN m.node ELSE m.root END AS root, r.node IS NOT NULL AS is_removed FROM m LEFT JOIN r ON r.root = m.root AND r.node = m.node")
def verify_removals(spark, d):
    members = _members(spark, d)
    verdicts = members.groupBy("root").agg(F.max("node").alias("n")).select(F.col("root").alias("cluster_id"), (F.col("root") % 2 != 0).alias("is_valid"), F.array("n").alias("members_to_remove"))
    return C.verify_members(members, verdicts).select("node", "root", "is_removed")


@query(f"WITH {_E}, x AS (SELECT label, unnest(v) y, generate_subscripts(v, 1) - 1 AS dim FROM e) SELECT label, dim, round(avg(y), 6) AS mean FROM x GROUP BY label, dim")
def topic_centroids(spark, d):
    means = taxonomy.centroids(_t(spark, d, "embeddings"), "label")
    return means.select("label", F.posexplode("embedding").alias("dim", "mean")).select("label", F.col("dim").cast("long").alias("dim"), F.round("mean", 6).alias("mean"))


def _vector_terms(spark, d) -> tuple[DataFrame, DataFrame]:
    """Terms 'term <vec_id>' and their clusters."""
    name = lambda c: F.concat(F.lit("term "), F.col(c).cast("string"))
    terms = _t(spark, d, "embeddings").select(name("vec_id").alias("term"), "embedding", F.array().cast("array<struct<sentence:string,source_file:string,char_start:int,char_end:int>>").alias("sample_contexts"))
    edges = _edges(spark, d).select(name("id_a").alias("id_a"), name("id_b").alias("id_b"))
    return terms, taxonomy.name_clusters(taxonomy.cluster_terms(terms, edges))


_CLUSTERS = f"{_MEMBERS}, g AS (SELECT list_sort(list('term ' || node)) terms FROM m GROUP BY root), topics AS (SELECT 'topic_' || substr(sha256(array_to_string(terms, chr(31))), 1, 8) AS id, 'Term ' || substr(terms[1], 6) AS canonical_name, 'Topic of ' || array_to_string(terms[1:5], ', ') AS description, array_to_string(terms, '|') AS terms, terms tl FROM g)"


@query(f"WITH {_CLUSTERS} SELECT id, canonical_name, description, terms FROM topics")
def flat_taxonomy(spark, d):
    terms, clusters = _vector_terms(spark, d)
    return taxonomy.flat_taxonomy(clusters, terms).select("id", "canonical_name", "description", F.array_join("terms", "|").alias("terms"))


@query(f"WITH {_CLUSTERS}, o AS (SELECT unnest(tl) term, id, canonical_name FROM topics) SELECT 'term ' || vec_id AS term, id AS topic_id, canonical_name FROM embeddings LEFT JOIN o ON term = 'term ' || vec_id")
def term_lookup(spark, d):
    terms, clusters = _vector_terms(spark, d)
    topics = taxonomy.flat_taxonomy(clusters, terms)
    return taxonomy.topic_by_term(terms.select("term"), taxonomy.term_topics(topics), topics)


def _geography(spark, d) -> DataFrame:
    region, nation, supplier = (_t(spark, d, t) for t in ("region", "nation", "supplier"))
    r = region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("canonical_name"), F.lit(None).cast("string").alias("parent_topic_id"))
    n = nation.select(F.concat(F.lit("n"), "n_nationkey"), "n_name", F.concat(F.lit("r"), "n_regionkey"))
    s = supplier.select(F.concat(F.lit("s"), "s_suppkey"), "s_name", F.concat(F.lit("n"), "s_nationkey"))
    return r.union(n).union(s)


@query("""WITH RECURSIVE t AS (SELECT 'r' || r_regionkey id, r_name nm, NULL::VARCHAR up FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, s_name, 'n' || s_nationkey FROM supplier),
p(id, path) AS (SELECT id, nm FROM t WHERE up IS NULL UNION ALL SELECT t.id, p.path || ' > ' || t.nm FROM t JOIN p ON t.up = p.id) SELECT id, path FROM p""")
def topic_path(spark, d):
    return taxonomy.topic_paths(_geography(spark, d)).select("id", F.array_join("path", " > ").alias("path"))


@query("""WITH v AS (SELECT doc_id, max(quality) = 1 ok FROM labels GROUP BY doc_id) SELECT d.doc_id AS term, coalesce(ok, false) AS is_valid_entity FROM documents d LEFT JOIN v USING (doc_id)""")
def entity_validation(spark, d):
    verdicts = _t(spark, d, "labels").groupBy(F.col("doc_id").alias("term")).agg((F.max("quality") == 1).alias("is_valid_entity"))
    return validate_entities(_t(spark, d, "documents").select(F.col("doc_id").alias("term")), verdicts)


def _hashed_sql(source: str, key: str, text: str, dim: int = 64) -> str:
    """CTE e(id, v): hashed embeddings of a table's texts."""
    codes = f"list_transform({_norm(text)}, lambda t: [('0x' || substr(md5(t), 1, 7))::BIGINT % {dim}, CASE WHEN ('0x' || substr(md5(t), 8, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END])"
    slots = f"list_transform(range(0, {dim}), lambda i: coalesce(list_sum(list_transform(list_filter(c, lambda x: x[1] = i), lambda x: x[2])), 0)::DOUBLE)"
    return f"e AS (SELECT id, {slots} v FROM (SELECT {key} id, {codes} c FROM {source}))"


def _joined_sql(k: int, threshold: float) -> str:
    """CTEs from e(id, v) to nn: neighbours by the slots that vectors share. A vector of zeros is near to none."""
    return f"""u AS MATERIALIZED (SELECT id, unnest(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))) x, generate_subscripts(v, 1) slot FROM e WHERE list_dot_product(v, v) > 0),
nz AS MATERIALIZED (SELECT * FROM u WHERE x <> 0),
s AS (SELECT a.id, b.id neighbor, round(sum(a.x * b.x), 9) score FROM nz a JOIN nz b USING (slot) WHERE a.id <> b.id GROUP BY ALL),
nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbor) rank FROM s WHERE score >= {threshold} QUALIFY rank <= {k})"""


_FOUND = f"""top AS MATERIALIZED (SELECT term, term_type, tfidf, df FROM scored ORDER BY tfidf DESC, term LIMIT 5000), {_hashed_sql('top', 'term', 'term')}, {_joined_sql(10, 0.75)},
edges AS (SELECT DISTINCT id u, neighbor w FROM nn WHERE 1 / (1 + exp(-15.0 * (score - 0.65))) >= 0.7), both_ AS (SELECT u, w FROM edges UNION SELECT w, u FROM edges),
reach(node, root) AS (SELECT u, u FROM both_ UNION SELECT w, root FROM reach JOIN both_ ON node = u), m AS (SELECT node, min(root) root FROM reach GROUP BY node),
g AS (SELECT list_sort(list(node)) terms FROM m GROUP BY root)"""


def _taxonomy(spark, d) -> taxonomy.Taxonomy:
    return taxonomy.build(_units(spark, d), HashingEmbedding(), config=taxonomy.TaxonomyConfig(similarity_threshold=0.75))


@query(f"WITH RECURSIVE {_CLUSTERS.removeprefix('RECURSIVE ')}, o AS (SELECT id, unnest(tl) term FROM topics) SELECT id AS topic_id, term, true AS is_root FROM o")
def taxonomy_json(spark, d):
    """A taxonomy written as one JSON text, saved, loaded and taken apart again."""
    terms, clusters = _vector_terms(spark, d)
    topics = taxonomy.flat_taxonomy(clusters, terms)
    path = scratch(spark, "taxonomy-json")
    save_taxonomy(topics, taxonomy.term_topics(topics), path)
    back = load_taxonomy(spark, path)
    found = back.select(F.explode("term_to_topic").alias("term", "topic_id"), "root_topics")
    return found.select("topic_id", "term", F.array_contains("root_topics", F.col("topic_id")).alias("is_root"))


@query(f"WITH RECURSIVE {_UNIT_CTE}, {_GRAM_CTE}, {_FOUND} SELECT 'topic_' || substr(sha256(array_to_string(terms, chr(31))), 1, 8) AS id, 'Topic of ' || array_to_string(terms[1:5], ', ') AS description, array_to_string(terms, '|') AS terms FROM g")
def taxonomy_from_texts(spark, d):
    """The taxonomy of a corpus from end to end, with hashed embeddings of the terms."""
    return _taxonomy(spark, d).topics.select("id", "description", F.array_join("terms", "|").alias("terms"))


@query(f"WITH RECURSIVE {_UNIT_CTE}, {_GRAM_CTE}, {_FOUND} SELECT (SELECT n FROM total) AS documents, (SELECT sum(len(t))::BIGINT FROM tokens) AS tokens, (SELECT count_if(k = 1)::BIGINT FROM terms) AS unigrams, (SELECT count_if(k = 2)::BIGINT FROM terms) AS bigrams, (SELECT count_if(k = 3)::BIGINT FROM terms) AS trigrams, (SELECT count(*) FROM top) AS terms_extracted, (SELECT count(*) FROM top) AS valid_entities, (SELECT count(*) FROM g) AS topics_created")
def taxonomy_stats(spark, d):
    return _taxonomy(spark, d).stats


_STATEMENTS = f"""docs AS (SELECT p_partkey id, p_name || ' ' || p_type || ' ' || p_brand AS text FROM part), {_hashed_sql('docs', 'id', 'text')}, {_joined_sql(20, 0.9)},
edges AS (SELECT DISTINCT id::VARCHAR u, neighbor::VARCHAR w FROM (SELECT * FROM nn) WHERE 1 / (1 + exp(-15.0 * (score - 0.65))) >= 0.6)"""


def _statement_sql() -> str:
    # Neighbours are ranked by the ids as text.
    sql = _STATEMENTS.replace("SELECT p_partkey id", "SELECT p_partkey::VARCHAR id")
    return f"""WITH RECURSIVE {sql}, both_ AS (SELECT u, w FROM edges UNION SELECT w, u FROM edges), reach(node, root) AS (SELECT u, u FROM both_ UNION SELECT w, root FROM reach JOIN both_ ON node = u),
m AS (SELECT node, min(root) root FROM reach GROUP BY node) SELECT id, coalesce({_uuid_sql('root')}, 'cluster_' || id) AS cluster_id FROM docs LEFT JOIN m ON node = id"""


@query(_statement_sql())
def cluster_statements(spark, d):
    """Clusters of the parts' statements from end to end, with hashed embeddings and a canary in every batch of ten pairs, strict."""
    docs = spread(_t(spark, d, "part")).select(F.col("p_partkey").cast("string").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"), F.lit(None).cast("string").alias("metadata"), F.lit(None).cast("array<float>").alias("embedding"))
    known = (("number of clients we serve", "we serve a number of clients", True), ("overall turnover", "goods left in the warehouse", False))
    return C.cluster(docs, HashingEmbedding(), config=C.ClusterConfig(similarity_threshold=0.9), checker=SanityChecker("strict", known)).select("id", "cluster_id")


@query("SELECT text FROM benchmark")
def text_files(spark, d):
    """Each benchmark text in a file of its own, below a folder that has none itself."""
    path = scratch(spark, "text-files")
    _t(spark, d, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    return read_text_files(spark, path).select(F.regexp_replace("text", "\n$", "").alias("text"))


@query("SELECT 'nation' || n_nationkey || ':line1' AS source, n_name || ' lies in region ' || n_regionkey AS text FROM nation")
def texts_in_memory(spark, d):
    rows = [(f"nation{r.n_nationkey}", f"{r.n_name} lies in region {r.n_regionkey}") for r in _t(spark, d, "nation").collect()]
    return corpus_units(from_texts(spark, rows)).select("source", "text")


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS text, CASE WHEN n_regionkey = 0 THEN NULL ELSE n_regionkey::VARCHAR END AS metadata FROM nation")
def documents_in_dicts(spark, d):
    rows = [{"id": str(r.n_nationkey), "text": r.n_name, "unknown": 1} | ({"metadata": str(r.n_regionkey)} if r.n_regionkey else {}) for r in _t(spark, d, "nation").collect()]
    return documents_from_dicts(spark, rows).select("id", "text", "metadata")


@query(f"WITH {_MEMBERS}, {_LABELS} SELECT id::VARCHAR AS id, cluster_id, len(embedding) AS dim, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM l JOIN embeddings ON vec_id = id")
def clusters_json(spark, d):
    """Labelled documents saved as JSON and loaded again."""
    path = scratch(spark, "clusters-json")
    labelled = _labels(spark, d).join(_t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")
    save_clusters(labelled.select(F.col("id").cast("string").alias("id"), F.lit("t").alias("text"), "embedding", "cluster_id"), C.cluster_count(labelled), path)
    return load_clusters(spark, path).select("id", "cluster_id", F.size("embedding").cast("long").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query(f"WITH {_MEMBERS}, {_LABELS} SELECT cluster_id, count(*) AS size, string_agg(id::VARCHAR, ',' ORDER BY id) AS members FROM l GROUP BY cluster_id")
def clusters_displayed(spark, d):
    shown = clusters_for_display(_labels(spark, d).withColumn("text", F.lit("t")))
    return shown.select("cluster_id", "size", F.array_join(F.transform("members", lambda m: m["id"].cast("string")), ",").alias("members"))


@query(rf"SELECT doc_id, regexp_replace(replace(text, chr(10), ' '), '^\s+|\s+$', '', 'g') AS text FROM documents")
def cleaned_texts(spark, d):
    """Nothing is embedded here, so a text of white space is no error: it is cleaned to an empty one."""
    return _t(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("text"))


@query(f"WITH {_hashed_sql('part', 'p_partkey', 'p_name')}, x AS (SELECT id, unnest(list_transform(v, lambda x: x / nullif(sqrt(list_dot_product(v, v)), 0))) y, generate_subscripts(v, 1) - 1 AS slot FROM e) SELECT id, slot, round(y, 5) AS value FROM x WHERE y <> 0 AND id % 2 = 1 UNION ALL SELECT p_partkey, 0, 9.0 FROM part WHERE p_partkey % 2 = 0")
def embedded_where_missing(spark, d):
    """Every other part comes with an embedding, which it keeps; the rest are embedded."""
    given = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit(9.0)).cast("array<float>"))
    rows = embed_missing(_t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), given.alias("embedding")), HashingEmbedding())
    return rows.select("id", F.posexplode("embedding").alias("slot", "value")).where("value <> 0").select("id", F.col("slot").cast("long").alias("slot"), F.round(F.col("value").cast("double"), 5).alias("value"))


@query(f"WITH {_NEXT} SELECT vec_a, vec_b, round(1 / (1 + exp(-15.0 * (list_cosine_similarity(va, vb) - 0.82))), 9) AS score FROM p")
def semantic_from_embeddings(spark, d):
    """With the default midpoint and steepness."""
    return _next_vectors(spark, d).select("vec_a", "vec_b", F.round(V.similarity_from_embeddings(F.col("va"), F.col("vb")), 9).alias("score"))


@query(f"WITH {_E} SELECT vec_id AS id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM e")
def index_added(spark, d):
    """An index of half of the vectors, to which the other half is added; a row without a vector isn't in it."""
    e = _t(spark, d, "embeddings")
    half = knn.build_index(e.where("label < 5").unionByName(e.where("label < 5").limit(1).select((-F.col("vec_id") - 1).alias("vec_id"), F.lit(None).cast("array<float>").alias("embedding"), "label")), "vec_id")
    return knn.add(half, knn.build_index(e.where("label >= 5"), "vec_id")).select("id", F.round(F.col("unit")[0], 6).alias("first"))


@query(f"WITH {_E} SELECT vec_id AS id, round(unnest(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) AS x FROM e WHERE vec_id = 7")
def index_lookup(spark, d):
    return knn.get_embedding(_index(spark, d), 7).select("id", F.explode("unit").alias("x")).select("id", F.round("x", 6).alias("x"))


@query(f"WITH {_E} SELECT vec_id AS id, round(list_cosine_similarity(v, (SELECT v FROM e WHERE vec_id = 5)), 6) AS score FROM e WHERE vec_id <> 5 AND list_cosine_similarity(v, (SELECT v FROM e WHERE vec_id = 5)) >= 0.1 ORDER BY round(list_cosine_similarity(v, (SELECT v FROM e WHERE vec_id = 5)), 9) DESC, vec_id LIMIT 10")
def search_by_id(spark, d):
    return knn.search_by_id(_index(spark, d), 5, 10, 0.1).withColumn("score", F.round("score", 6))


@query(f"WITH {_CANDIDATES} SELECT id_a, id_b, 'about ' || id_a || '; about ' || id_a || ' again; more of ' || id_a AS contexts_a FROM c")
def term_candidates(spark, d):
    """Candidate pairs of terms with the first three of each side's contexts."""
    sentence = lambda *parts: F.concat(*[F.lit(x) if x else F.col("vec_id").cast("string") for x in parts])
    contexts = F.transform(F.array(sentence("about ", ""), sentence("about ", "", " again"), sentence("more of ", ""), sentence("not ", "")), lambda x: F.struct(x.alias("sentence"), F.lit("f").alias("source_file"), F.lit(0).alias("char_start"), F.lit(1).alias("char_end")))
    terms = _t(spark, d, "embeddings").select(F.col("vec_id").alias("term"), "embedding", contexts.alias("sample_contexts"))
    found = taxonomy.term_candidates(terms, 10, NEAR)
    return found.select("id_a", "id_b", F.array_join(F.transform("contexts_a", lambda x: x["sentence"]), "; ").alias("contexts_a"))


@query("SELECT DISTINCT doc_id // 10 AS batch_id FROM documents WHERE ('0x' || substr(md5((doc_id // 10) || ':0'), 1, 7))::BIGINT % 1000000 < 300000")
def canary_sample(spark, d):
    """The batches that sample mode checks."""
    return SanityChecker("sample", sample_rate=0.3).inject(_batched(spark, d)).where("is_canary").select("batch_id")


@query("SELECT doc_id * 7 + 3 AS pair_id, (row_number() OVER (ORDER BY doc_id) - 1) // 10 AS batch_id FROM documents")
def dense_batch_ids(spark, d):
    """Keys with gaps make slices of ten all the same."""
    return dense_batches(_batched(spark, d).drop("batch_id").withColumn("pair_id", F.col("pair_id") * 7 + 3)).select("pair_id", F.col("batch_id").cast("long").alias("batch_id"))


@query("""WITH v AS (SELECT doc_id, max(quality) = 1 ok FROM labels GROUP BY doc_id) SELECT d.doc_id AS term, CASE WHEN d.doc_id // 10 % 7 = 0 THEN true ELSE coalesce(ok, false) END AS is_valid_entity FROM documents d LEFT JOIN v USING (doc_id)""")
def entity_validation_failed_batches(spark, d):
    """Batches that failed as a whole accept their terms."""
    verdicts = _t(spark, d, "labels").groupBy(F.col("doc_id").alias("term")).agg((F.max("quality") == 1).alias("is_valid_entity"))
    terms = assign_batches(_t(spark, d, "documents").select(F.col("doc_id").alias("term")), key="term")
    failed = terms.where("batch_id % 7 = 0").select("batch_id").distinct()
    return validate_entities(terms, verdicts, failed).select("term", "is_valid_entity")


@query("""SELECT d.doc_id AS pair_id, max(l.quality) * 0.75 AS confidence FROM documents d JOIN labels l USING (doc_id) GROUP BY 1 HAVING max(l.toxic) = 1 AND max(l.quality) * 0.75 >= 0.7""")
def recorded_verdicts(spark, d):
    """Pairs with verdicts of a table: a pair that it lacks is no match."""
    said = _t(spark, d, "labels").groupBy(F.col("doc_id").alias("pair_id")).agg((F.max("toxic") == 1).alias("is_similar"), (F.max("quality") * 0.75).cast("double").alias("confidence"))
    pairs = _batched(spark, d)
    return accepted(pairs, RecordedJudge(said).verdicts(pairs), 0.7).select("pair_id", "confidence")


@query(f"WITH {_MEMBERS}, big AS (SELECT root FROM m GROUP BY root HAVING count(*) > 1) SELECT vec_id AS id, CASE WHEN root IS NULL OR (node = root AND root IN (FROM big) AND root % 2 = 0) THEN 'cluster_' || vec_id ELSE {_uuid_sql('root::VARCHAR')} END AS cluster_id FROM embeddings LEFT JOIN m ON node = vec_id")
def removed_roots(spark, d):
    """Verdicts that remove a cluster's root, and some on clusters that there aren't."""
    members = _members(spark, d)
    heads = members.select("root").distinct()
    verdicts = heads.select(F.col("root").alias("cluster_id"), (F.col("root") % 2 != 0).alias("is_valid"), F.array("root").alias("members_to_remove")).unionByName(heads.select((-F.col("root") - 1).alias("cluster_id"), F.lit(False).alias("is_valid"), F.array("root").alias("members_to_remove")))
    return C.label(_t(spark, d, "embeddings").select(F.col("vec_id").alias("id")), C.verify_members(members, verdicts))


def _items(spark, d) -> DataFrame:
    """Regions, nations, suppliers as a hierarchy; a nation has its suppliers' names among its terms, a region those of the cluster of its name."""
    region, nation, supplier = (_t(spark, d, t) for t in ("region", "nation", "supplier"))
    own = supplier.groupBy("s_nationkey").agg(F.sort_array(F.collect_list("s_name")).alias("names"))
    none = F.array().cast("array<string>")
    r = region.select(F.concat(F.lit("r"), "r_regionkey").alias("item_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").cast("int").alias("position"), F.col("r_name").alias("name"), F.lit("").alias("description"), none.alias("terms"))
    n = nation.join(own, nation.n_nationkey == own.s_nationkey, "left").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.col("n_nationkey").cast("int"), "n_name", F.lit(""), F.concat(F.array("n_name"), F.coalesce("names", none)))
    s = supplier.select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), F.col("s_suppkey").cast("int"), "s_name", F.lit(""), F.array("s_name"))
    lost = region.select(F.concat(F.lit("x"), "r_regionkey"), F.concat(F.lit("x"), ((F.col("r_regionkey") + 1) % 5).cast("int")), F.lit(0), F.lit("cycle"), F.lit(""), F.array(F.lit("never")))
    return r.union(n).union(s).union(lost)


def _hierarchy(spark, d) -> tuple[DataFrame, DataFrame]:
    named = _t(spark, d, "region").select(F.concat(F.lit("c"), "r_regionkey").alias("cluster_id"), F.array(F.concat("r_name", F.lit(" term"))).alias("terms"), F.array().cast("array<struct<sentence:string,source_file:string,char_start:int,char_end:int>>").alias("sample_contexts"), F.col("r_name").alias("suggested_name"))
    terms = _t(spark, d, "nation").select(F.col("n_name").alias("term"), F.array(F.col("n_regionkey").cast("float")).alias("embedding"))
    return taxonomy.hierarchical_taxonomy(_items(spark, d), named, terms)


_TOPIC = "'topic_' || substr(sha256(%s), 1, 8)"


@query(f"""WITH t AS (SELECT 'r' || r_regionkey id, r_name nm, NULL::VARCHAR up, 1 n_terms, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) below FROM region
UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey, 1 + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey), (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) FROM nation
UNION ALL SELECT 's' || s_suppkey, s_name, 'n' || s_nationkey, 1, 0 FROM supplier) SELECT {_TOPIC % 'id'} AS id, nm AS canonical_name, {_TOPIC % 'up'} AS parent_topic_id, n_terms, below AS n_children FROM t""")
def hierarchical_topics(spark, d):
    """A hierarchy with a cycle, which is left out."""
    return _hierarchy(spark, d)[0].select("id", "canonical_name", "parent_topic_id", F.size("terms").cast("long").alias("n_terms"), F.size("children").cast("long").alias("n_children"))


@query(f"""WITH o AS (SELECT s_name term, {_TOPIC % "'n' || s_nationkey"} topic_id FROM supplier UNION ALL SELECT n_name, {_TOPIC % "'n' || n_nationkey"} FROM nation UNION ALL SELECT r_name || ' term', {_TOPIC % "'r' || r_regionkey"} FROM region) SELECT term, topic_id FROM o""")
def hierarchical_term_owners(spark, d):
    """A supplier's name is a term of the supplier and of its nation, which is written later."""
    return _hierarchy(spark, d)[1].select("term", "topic_id")


@query(f"WITH {_CLUSTERS} SELECT DISTINCT unnest(tl) AS term FROM topics")
def taxonomy_terms(spark, d):
    terms, clusters = _vector_terms(spark, d)
    return taxonomy.all_terms(taxonomy.term_topics(taxonomy.flat_taxonomy(clusters, terms)))


@query(f"WITH {_MEMBERS}, g AS (SELECT list_sort(list('term ' || node)) terms FROM m GROUP BY root) SELECT 'cluster_' || substr(sha256(array_to_string(terms, chr(31))), 1, 8) AS cluster_id, array_to_string(flatten(list_transform(terms, lambda t: ['first of ' || t, 'second of ' || t]))[1:5], '; ') AS contexts FROM g")
def cluster_contexts(spark, d):
    """The first two contexts of each member, the first five of a cluster."""
    terms = _t(spark, d, "embeddings").select(F.concat(F.lit("term "), F.col("vec_id").cast("string")).alias("term"))
    of = F.array(*[F.struct(F.concat(F.lit(f"{n} of "), F.col("term")).alias("sentence"), F.lit("f").alias("source_file"), F.lit(0).alias("char_start"), F.lit(1).alias("char_end")) for n in ("first", "second", "third")])
    edges = _edges(spark, d).select(*[F.concat(F.lit("term "), F.col(c).cast("string")).alias(c) for c in ("id_a", "id_b")])
    found = taxonomy.cluster_terms(terms.withColumn("sample_contexts", of), edges)
    return found.select("cluster_id", F.array_join(F.transform("sample_contexts", lambda x: x["sentence"]), "; ").alias("contexts"))


@query(f"""WITH {_UNIT_CTE}, {_GRAM_CTE}, top AS MATERIALIZED (SELECT term FROM scored ORDER BY tfidf DESC, term LIMIT 300), f AS (SELECT doc_id, list_sort(list(term)) topics FROM documents JOIN top ON instr(lower(text), term) > 0 GROUP BY doc_id)
SELECT doc_id, coalesce(array_to_string(topics, ','), '') AS topics FROM documents LEFT JOIN f USING (doc_id)""")
def topic_extract_terms(spark, d):
    """The topics of a corpus' own terms, one each, in all documents."""
    terms = store(tfidf.extract_terms(_units(spark, d), tfidf.TermConfig(top_n=300)), "extracted-terms").select("term", F.col("term").alias("topic_id"))
    return extract_topics(_t(spark, d, "documents"), terms, "doc_id").select("doc_id", F.array_join("topics", ",").alias("topics"))


@query(f"""WITH {_UNIT_CTE}, {_GRAM_CTE}, top AS (SELECT term FROM scored ORDER BY tfidf DESC, term LIMIT 1),
lines AS (SELECT doc_id, unit_no, unnest(s) AS sentence, generate_subscripts(s, 1) AS line_no FROM (SELECT doc_id, unit_no, list_filter(list_transform(string_split(unit, chr(10)), lambda l: lower({_strip('l')})), lambda l: length(l) > 10) s FROM units)),
has AS (SELECT DISTINCT doc_id, unit_no, term FROM grams WHERE term IN (FROM top)),
hits AS (SELECT term, sentence, row_number() OVER (ORDER BY doc_id, unit_no, line_no) nth FROM has JOIN lines USING (doc_id, unit_no) WHERE instr(sentence, term) > 0)
SELECT term, nth, sentence FROM hits WHERE nth <= 2""")
def contexts_of_term(spark, d):
    units = _units(spark, d)
    best = store(tfidf.extract_terms(units, tfidf.TermConfig(top_n=1)), "extracted-terms")
    contexts = tfidf.term_contexts(units, best)
    return contexts.join(best.select("term"), "term", "left_semi").where("nth <= 2").select("term", "nth", "sentence")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
