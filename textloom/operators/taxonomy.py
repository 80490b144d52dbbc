"""Topics from terms: clusters, names, hierarchy, lookup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import title_case
from textloom.functions.vector import short_id
from textloom.operators.graph import connected_components
from textloom.operators.judge import Judge, RuleJudge, accepted, dense_batches, validate_entities
from textloom.operators.knn import build_index, candidate_pairs, top_k, with_contexts
from textloom.operators.tfidf import TermConfig, context_lists, corpus_statistics, extract_terms, term_contexts, term_statistics
from textloom.providers import Embedding, embed_missing
from textloom.sources.shared import fresh, store


@dataclass(frozen=True)
class TaxonomyConfig:
    top_n: int = 5000
    contexts_per_term: int = 5
    min_df: int = 2
    max_df_ratio: float = 0.8
    knn_k: int = 10
    similarity_threshold: float = 0.6
    min_confidence: float = 0.7
    batch_size: int = 10
    keep_singletons: bool = False


def cluster_terms(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster_id, terms, sample_contexts, suggested_name) of the components of accepted term pairs; a term without a match has no cluster.

    The first two contexts of each member, the first five of a cluster.
    """
    members = connected_components(edges, "id_a", "id_b").select(F.col("node").alias("term"), "root")
    rows = members.join(terms.select("term", "sample_contexts"), "term")
    item = F.struct("term", F.slice(F.coalesce("sample_contexts", F.array()), 1, 2).alias("c"))
    grouped = rows.groupBy("root").agg(F.array_sort(F.collect_list(item)).alias("m"))
    names = F.transform("m", lambda x: x["term"])
    contexts = F.slice(F.flatten(F.transform("m", lambda x: x["c"])), 1, 5)
    return grouped.select(F.concat(F.lit("cluster_"), short_id(names)).alias("cluster_id"), names.alias("terms"), contexts.alias("sample_contexts"), F.lit(None).cast("string").alias("suggested_name"))


def name_clusters(clusters: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """suggested_name from a table (cluster_id, name), else the first term in title case."""
    own = title_case(F.col("terms")[0])
    if names is None:
        return clusters.withColumn("suggested_name", own)
    (given,) = fresh(clusters.columns, "_name")
    return clusters.join(names.select("cluster_id", F.col("name").alias(given)), "cluster_id", "left").withColumn("suggested_name", F.coalesce(given, own)).drop(given)


def centroids(members: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, embedding): the mean of each group's vectors, summed by dimension."""
    flat = members.where(F.col(vector).isNotNull()).select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("_i", "_x"))
    means = flat.groupBy(key, "_i").agg(F.avg("_x").alias("_x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("embedding"))


def flat_taxonomy(clusters: DataFrame, terms: DataFrame) -> DataFrame:
    """A topic for each cluster, none below another."""
    means = centroids(clusters.select("cluster_id", F.explode("terms").alias("term")).join(terms.select("term", "embedding"), "term"), "cluster_id")
    out = clusters.join(means, "cluster_id", "left")
    return out.select(
        F.concat(F.lit("topic_"), short_id(F.col("terms"))).alias("id"),
        F.coalesce("suggested_name", title_case(F.col("terms")[0])).alias("canonical_name"),
        F.concat(F.lit("Topic of "), F.array_join(F.slice("terms", 1, 5), ", ")).alias("description"),
        "terms",
        F.lit(None).cast("string").alias("parent_topic_id"),
        F.array().cast("array<string>").alias("children"),
        F.coalesce("embedding", F.array().cast("array<double>")).alias("embedding"),
        F.slice("sample_contexts", 1, 3).alias("sample_contexts"),
    )


def _way_up(nodes: DataFrame, item: str) -> DataFrame:
    """(id, way, up): for nodes (id, up, item) the items from the topmost ancestor down to each, however deep, by doubling.

    As many rounds as the logarithm of the depth, each a join on keys. up is null where the way has ended,
    at a root or above a missing parent; in a cycle it never does, and the way then repeats.
    """
    now = store(nodes.select("id", F.array(item).alias("way"), "up"), "ways")
    rounds = max(1, now.count()).bit_length() + 1
    for _ in range(rounds):
        if now.where("up is not null").isEmpty():
            break
        above = now.select(F.col("id").alias("up"), F.col("way").alias("above"), F.col("up").alias("next"))
        now = store(now.join(above, "up", "left").select("id", F.concat(F.coalesce("above", F.array().cast(now.schema["way"].dataType)), "way").alias("way"), F.col("next").alias("up")), "ways")
    return now


def hierarchy_order(items: DataFrame) -> DataFrame:
    """(item_id, path, depth): path sorts items depth first, parents first. Items in a cycle, or below none of the roots, are left out."""
    own = items.select(F.col("item_id").alias("id"), F.col("parent_id").alias("up"), F.struct(F.format_string("%08d", "position").alias("at"), F.col("parent_id").isNull().alias("top")).alias("step"))
    ways = _way_up(own, "step").where("up is null").where(F.col("way")[0]["top"])
    return ways.select(F.col("id").alias("item_id"), F.transform("way", lambda x: x["at"]).alias("path"), (F.size("way") - 1).alias("depth"))


def hierarchical_taxonomy(items: DataFrame, clusters: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topics, term_topic) of a hierarchy of edges (schemas.HIERARCHY).

    An item's terms are its own, or else those of the cluster of its name (of equal names the greatest
    cluster_id). A term in several topics belongs to the one that is written last when children are
    written before their parents and roots in order: the ancestor, and of siblings the later.
    """
    named = clusters.where("suggested_name is not null").groupBy(F.col("suggested_name").alias("name")).agg(F.max_by(F.struct("terms", "sample_contexts"), "cluster_id").alias("_c"))
    placed = items.join(hierarchy_order(items), "item_id").join(named, "name", "left")
    placed = placed.withColumn("terms", F.when(F.size("terms") > 0, F.col("terms")).otherwise(F.coalesce("_c.terms", F.array().cast("array<string>"))))
    topic = F.concat(F.lit("topic_"), F.substring(F.sha2(F.col("item_id"), 256), 1, 8))
    # Post-order: a path sorts after all paths that it begins.
    key = F.concat(F.array_join("path", "."), F.lit(".~"))
    owned = placed.select(F.explode("terms").alias("term"), topic.alias("topic_id"), key.alias("_k"))
    term_topic = owned.groupBy("term").agg(F.max_by("topic_id", "_k").alias("topic_id"))
    means = centroids(placed.select("item_id", F.explode("terms").alias("term")).join(terms.select("term", "embedding"), "term"), "item_id")
    below = placed.where("parent_id is not null").groupBy(F.col("parent_id").alias("item_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", topic.alias("t")))), lambda x: x["t"]).alias("children"))
    up = F.when(F.col("parent_id").isNotNull(), F.concat(F.lit("topic_"), F.substring(F.sha2(F.col("parent_id"), 256), 1, 8)))
    topics = placed.join(means, "item_id", "left").join(below, "item_id", "left").select(topic.alias("id"), F.col("name").alias("canonical_name"), "description", "terms", up.alias("parent_topic_id"), F.coalesce("children", F.array().cast("array<string>")).alias("children"), F.coalesce("embedding", F.array().cast("array<double>")).alias("embedding"), F.slice(F.coalesce("_c.sample_contexts", F.array()), 1, 3).alias("sample_contexts"))
    return topics, term_topic


def term_topics(topics: DataFrame) -> DataFrame:
    """(term, topic_id); of several topics the greatest id."""
    return topics.select(F.explode("terms").alias("term"), F.col("id").alias("topic_id")).groupBy("term").agg(F.max("topic_id").alias("topic_id"))


def topic_by_term(terms: DataFrame, term_topic: DataFrame, topics: DataFrame) -> DataFrame:
    """terms with topic_id and canonical_name; exact and case-sensitive; null where there is none."""
    return terms.join(term_topic, "term", "left").join(topics.select(F.col("id").alias("topic_id"), "canonical_name"), "topic_id", "left").select("term", "topic_id", "canonical_name")


def all_terms(term_topic: DataFrame) -> DataFrame:
    return term_topic.select("term")


def topic_paths(topics: DataFrame) -> DataFrame:
    """(id, path): names from the root down to each topic, however deep. A missing parent ends the way up, and so does the first topic that comes again in a cycle."""
    nodes = topics.select("id", F.col("parent_topic_id").alias("up"), F.struct("id", F.col("canonical_name").alias("name")).alias("step"))
    # The way up from a topic is decided by the topic, so after the first that repeats all repeat.
    ways = _way_up(nodes, "step").withColumn("back", F.reverse("way"))
    once = F.slice("back", 1, F.greatest(F.size(F.array_distinct(F.transform("back", lambda x: x["id"]))), F.lit(1)))
    return ways.select("id", F.transform(F.reverse(F.when(F.col("up").isNull(), F.col("back")).otherwise(once)), lambda x: x["name"]).alias("path"))


@dataclass(frozen=True)
class Taxonomy:
    """What `build` made; terms are those extracted, with contexts, verdict and embedding."""

    topics: DataFrame
    term_topic: DataFrame
    stats: DataFrame
    terms: DataFrame
    clusters: DataFrame

    def __iter__(self):
        return iter((self.topics, self.term_topic, self.stats))


def complete_stats(corpus: DataFrame, terms: DataFrame, topics: DataFrame) -> DataFrame:
    """The corpus' statistics with valid_entities and topics_created."""
    return corpus.crossJoin(terms.agg(F.count_if("is_valid_entity").alias("valid_entities"))).crossJoin(topics.agg(F.count("*").alias("topics_created")))


def term_candidates(terms: DataFrame, knn_k: int, threshold: float) -> DataFrame:
    """(pair_id, id_a, id_b, score, contexts_a, contexts_b): neighbours among terms (term, embedding, sample_contexts), each pair once. No embedding at all is a ValueError."""
    index = build_index(terms, "term")
    if index.isEmpty():
        raise ValueError("no term has an embedding")
    pairs = candidate_pairs(top_k(index, index, knn_k, threshold)).withColumn("pair_id", F.abs(F.xxhash64("id_a", "id_b") % (1 << 62)))
    return with_contexts(pairs, terms.select(F.col("term").alias("id"), "sample_contexts"))


def build(units: DataFrame, provider: Embedding, judge: Judge | None = None, entity_verdicts: DataFrame | None = None, names: DataFrame | None = None, hierarchy: DataFrame | None = None, config: TaxonomyConfig = TaxonomyConfig(), strict: bool = False) -> Taxonomy:
    """The taxonomy of corpus units. strict, as for files: no unit, no valid term or no embedding is a ValueError.

    Up to five clusters, or without a hierarchy, the taxonomy is flat. The corpus is read for the statistics
    of its n-grams, for two sums, and for the contexts of the terms; everything of the size of the terms is
    written once and read again. A term that comes with an embedding keeps it; a term pair without a verdict is no match.
    """
    if strict and units.isEmpty():
        raise ValueError("there are no documents")
    statistics = store(term_statistics(units), "term-statistics")
    found = store(extract_terms(units, TermConfig(config.min_df, config.max_df_ratio, config.contexts_per_term, config.top_n), statistics), "extracted-terms")
    contexts = context_lists(term_contexts(units, found, config.contexts_per_term))
    terms = found.join(contexts, "term", "left")
    terms = validate_entities(terms, entity_verdicts) if entity_verdicts is not None else terms.withColumn("is_valid_entity", F.lit(True))
    valid = terms.where("is_valid_entity")
    embedded = embed_missing(valid.withColumn("embedding", F.lit(None).cast("array<float>")), provider, "term")
    terms = store(embedded.unionByName(terms.where("not is_valid_entity").withColumn("embedding", F.lit(None).cast("array<float>"))), "terms")
    valid = terms.where("is_valid_entity")
    if strict and valid.isEmpty():
        raise ValueError("there are no valid terms")
    if strict and valid.where("embedding is not null").isEmpty():
        raise ValueError("no term has an embedding")
    if valid.where("embedding is not null").isEmpty():
        edges = valid.select(F.col("term").alias("id_a"), F.col("term").alias("id_b")).limit(0)
    else:
        pairs = store(dense_batches(term_candidates(valid, config.knn_k, config.similarity_threshold), config.batch_size), "term-candidates")
        edges = accepted(pairs, store((judge or RuleJudge(config.similarity_threshold)).verdicts(pairs), "term-verdicts"), config.min_confidence)
    clusters = store(name_clusters(cluster_terms(valid, edges), names), "term-clusters")
    if hierarchy is not None and clusters.limit(6).count() > 5:
        topics, term_topic = hierarchical_taxonomy(hierarchy, clusters, valid)
    else:
        topics = flat_taxonomy(clusters, valid)
        term_topic = term_topics(topics)
    return Taxonomy(topics, term_topic, complete_stats(corpus_statistics(units, found, statistics), terms, topics), terms, clusters)
