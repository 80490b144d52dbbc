"""Clusters of statements that say the same: neighbours, judge, components, verification, labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.vector import cluster_uuid, cosine_similarity
from textloom.operators.graph import connected_components
from textloom.operators.judge import Judge, RuleJudge, SanityChecker, accepted, dense_batches
from textloom.operators.knn import build_index, candidate_pairs, checked, top_k
from textloom.providers import Embedding, embed_distinct, embed_missing
from textloom.sources.shared import fresh, store


@dataclass(frozen=True)
class ClusterConfig:
    knn_k: int = 20
    similarity_threshold: float = 0.7
    sanity_mode: str = "strict"
    batch_size: int = 10
    min_confidence: float = 0.6

    @classmethod
    def from_config(cls, config: dict) -> ClusterConfig:
        """Unknown keys are ignored."""
        return cls(**{k: v for k, v in config.items() if k in {f.name for f in fields(cls)}})


class Verifier(Protocol):
    def verdicts(self, clusters: DataFrame) -> DataFrame:
        """schemas.CLUSTER_VERDICT of clusters (cluster_id, members array<struct<id, text>>)."""
        ...


@dataclass(frozen=True)
class CallableVerifier:
    """A function from a list of clusters ({cluster_id, members}) to a list of verdicts ({cluster_id, is_valid, members_to_remove}), called batch_size clusters at a time. Its errors are raised."""

    call: Callable[[list[dict]], list[dict]]
    batch_size: int = 10
    concurrency: int = 8

    def verdicts(self, clusters: DataFrame) -> DataFrame:
        call, size = self.call, self.batch_size
        kind = clusters.schema["cluster_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = b.to_pylist()
                for at in range(0, len(rows), size):
                    said = call(rows[at : at + size])
                    yield pa.RecordBatch.from_pylist([{"cluster_id": x["cluster_id"], "is_valid": bool(x["is_valid"]), "members_to_remove": list(x.get("members_to_remove") or [])} for x in said], schema=pa.schema([("cluster_id", b.schema.field("cluster_id").type), ("is_valid", pa.bool_()), ("members_to_remove", pa.list_(b.schema.field("cluster_id").type))]))

        return clusters.repartition(self.concurrency, "cluster_id").mapInArrow(run, f"cluster_id {kind}, is_valid boolean, members_to_remove array<{kind}>")


def clusters_to_verify(members: DataFrame, documents: DataFrame) -> DataFrame:
    """(cluster_id, members: (id, text) by id) of the clusters of two or more."""
    rows = members.select(F.col("node").alias("id"), F.col("root").alias("cluster_id")).join(documents.select("id", "text"), "id")
    return rows.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("members")).where(F.size("members") > 1)


def verify_members(members: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(node, root, is_removed, old_root) after verification. members: (node, root).

    Only clusters of two or more are verified, and only a verdict that isn't valid and names members
    removes them; each becomes a cluster of its own. Verdicts on unknown clusters and members do nothing.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
    gone = verdicts.where("not is_valid and size(members_to_remove) > 0").join(sizes, F.col("cluster_id") == F.col("root"), "left_semi").select(F.col("cluster_id").alias("root"), F.explode("members_to_remove").alias("node")).distinct().withColumn("is_gone", F.lit(True))
    out = members.select("node", "root").join(gone, ["root", "node"], "left")
    return out.select("node", F.when(F.col("is_gone"), F.col("node")).otherwise(F.col("root")).alias("root"), F.coalesce("is_gone", F.lit(False)).alias("is_removed"), F.col("root").alias("old_root"))


def label(documents: DataFrame, members: DataFrame, id_column: str = "id") -> DataFrame:
    """documents with cluster_id: cluster_<uuid5 of the root>, or cluster_<id> without a cluster.

    A removed root loses its entry to the cluster it headed, so it is labelled by its id.
    """
    if "is_removed" not in members.columns:
        members = members.withColumn("is_removed", F.lit(False)).withColumn("old_root", F.col("root"))
    (own,) = fresh(documents.columns, "_label")
    known = members.select(F.col("node").alias(id_column), F.when(F.col("is_removed") & (F.col("node") == F.col("old_root")), F.lit(None)).otherwise(cluster_uuid(F.col("root").cast("string"))).alias(own))
    out = documents.drop("cluster_id").join(known, id_column, "left")
    return out.withColumn("cluster_id", F.coalesce(own, F.concat(F.lit("cluster_"), F.col(id_column).cast("string")))).drop(own)


def cluster_count(labelled: DataFrame) -> DataFrame:
    return labelled.agg(F.count_distinct(F.when(F.col("cluster_id") != "", F.col("cluster_id"))).alias("cluster_count"))


def judged_pairs(index: DataFrame, config: ClusterConfig) -> DataFrame:
    """(pair_id, id_a, id_b, score): candidate pairs, keyed by a hash of the ids."""
    pairs = candidate_pairs(top_k(index, index, config.knn_k, config.similarity_threshold))
    return pairs.withColumn("pair_id", F.abs(F.xxhash64("id_a", "id_b") % (1 << 62)))


def canary_scores(injected: DataFrame, provider: Embedding) -> DataFrame:
    """(pair_id, score): the cosine of each canary's texts, embedded as any other text is."""
    own = injected.where("is_canary").select("pair_id", "text_a", "text_b")
    known = embed_distinct(own.select(F.explode(F.array("text_a", "text_b")).alias("text")), provider)
    for x in "ab":
        own = own.join(known.select(F.col("text").alias(f"text_{x}"), F.col("embedding").alias(f"embedding_{x}")), f"text_{x}")
    return own.select("pair_id", cosine_similarity(F.col("embedding_a"), F.col("embedding_b")).alias("score"))


def cluster(documents: DataFrame, provider: Embedding, judge: Judge | None = None, config: ClusterConfig = ClusterConfig(), verify: DataFrame | Verifier | None = None, checker: SanityChecker | None = None) -> DataFrame:
    """documents (id, text, embedding, ...) with cluster_id. Without a judge, the similarity threshold decides.

    Every batch of batch_size pairs has its canaries, as config.sanity_mode says (strict: a canary judged
    wrongly, or not at all, is a SanityCheckError); "off" injects none. Texts are embedded and pairs judged
    once: both are written before they are used. Ids that repeat are a ValueError. Each cluster is verified
    where there is a verifier or a table of verdicts; that pass has no canaries.
    """
    documents = store(embed_missing(documents, provider), "embedded-documents")
    pairs = store(judged_pairs(checked(build_index(documents)), config), "judged-pairs")
    judge = judge or RuleJudge(config.similarity_threshold)
    if checker is None and config.sanity_mode != "off":
        checker = SanityChecker(config.sanity_mode)
    texts = documents.select("id", "text")
    numbered = dense_batches(pairs, config.batch_size)  # before the texts come in, which they needn't pass through
    batched = numbered.join(texts.select(F.col("id").alias("id_a"), F.col("text").alias("text_a")), "id_a").join(texts.select(F.col("id").alias("id_b"), F.col("text").alias("text_b")), "id_b")
    if checker is None:
        verdicts = store(judge.verdicts(batched), "verdicts")
    else:
        injected = store(checker.inject(batched.withColumns({c: F.col(c).cast("string") for c in ("id_a", "id_b")}), numbered), "injected-pairs")
        scores = pairs.select("pair_id", "score").unionByName(canary_scores(injected, provider))
        verdicts = store(judge.verdicts(injected.join(scores, "pair_id", "left")), "verdicts")
        verdicts = checker.validate(injected, verdicts)
    edges = accepted(pairs, verdicts, config.min_confidence)
    members = connected_components(edges, "id_a", "id_b")
    if verify is not None:
        said = verify if isinstance(verify, DataFrame) else store(verify.verdicts(clusters_to_verify(members, documents)), "cluster-verdicts")
        members = verify_members(members, said)
    return label(documents, members)
