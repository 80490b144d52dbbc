"""Reading corpora, saving and loading results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import schemas
from textloom.functions.text import sentence_units


def read_text_files(spark: SparkSession, directory: str, pattern: str = "*.txt") -> DataFrame:
    """(source, text) of the matching files of any file system that Spark reads; below the directory too only where it has none itself. A missing directory is a ValueError; unreadable files are left out."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(directory)
    system = path.getFileSystem(conf)
    if not system.exists(path) or not system.getFileStatus(path).isDirectory():
        raise ValueError(f"{directory} is not a directory")
    matches = system.globStatus(jvm.org.apache.hadoop.fs.Path(path, pattern)) or []
    below = not any(f.isFile() for f in matches)
    read = spark.read.option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True).option("recursiveFileLookup", below)
    return read.text([directory], wholetext=True).select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))


def from_texts(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(texts, "source string, text string")


def corpus_units(texts: DataFrame, sentence_level: bool = True, order: str | None = None) -> DataFrame:
    """(source, ord, unit_no, text): what term extraction counts as documents. Sentence units are named source:line{n} and have more than 10 characters; n counts before that filter."""
    ordinal = F.col(order) if order else F.xxhash64("source", "text")
    if not sentence_level:
        return texts.select("source", ordinal.alias("ord"), F.lit(0).alias("unit_no"), "text")
    units = texts.select("source", ordinal.alias("ord"), F.posexplode(sentence_units(F.col("text"))).alias("unit_no", "text"))
    return units.where(F.length("text") > 10).withColumn("source", F.concat("source", F.lit(":line"), (F.col("unit_no") + 1).cast("string")))


def documents_from_dicts(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Missing optional keys are null, unknown keys are ignored, a missing id or text or a repeated id is a ValueError."""
    names = ("id", "text", "metadata", "embedding", "cluster_id")
    if any(r.get("id") is None or r.get("text") is None for r in rows):
        raise ValueError("a document needs id and text")
    if len({r["id"] for r in rows}) < len(rows):
        raise ValueError("ids repeat")
    return spark.createDataFrame([tuple(r.get(k) for k in names) for r in rows], schemas.DOCUMENT)


def save_clusters(documents: DataFrame, stats: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(f"{path}/documents")
    stats.write.mode("overwrite").json(f"{path}/stats")


def load_clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DOCUMENT).option("mode", "FAILFAST").json(f"{path}/documents")


def taxonomy_document(topics: DataFrame, term_topic: DataFrame, stats: DataFrame | None = None, created_at: str | None = None) -> DataFrame:
    """One row, one JSON text: the taxonomy as a single document, made at created_at (ISO 8601; now, if it isn't given)."""
    body = topics.agg(F.array_sort(F.collect_list(F.struct(*topics.columns))).alias("topics"), F.array_sort(F.collect_list(F.when(F.col("parent_topic_id").isNull(), F.col("id")))).alias("root_topics"))
    terms = term_topic.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "topic_id")))).alias("term_to_topic"))
    whole = body.crossJoin(F.broadcast(terms)).withColumn("created_at", F.lit(created_at or datetime.now().isoformat()))
    if stats is not None:
        pairs = F.create_map(*[x for c in stats.columns for x in (F.lit(c), F.col(c).cast("string"))])
        whole = whole.crossJoin(F.broadcast(stats.select(pairs.alias("source_stats"))))
    return whole.select(F.to_json(F.struct(*whole.columns)).alias("taxonomy"))


def save_taxonomy(topics: DataFrame | None, term_topic: DataFrame | None, path: str, stats: DataFrame | None = None) -> None:
    if topics is None or term_topic is None:
        raise ValueError("there is no taxonomy to save")
    taxonomy_document(topics, term_topic, stats).write.mode("overwrite").text(path)


def load_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """One row with the columns of schemas.TAXONOMY; malformed JSON is an error."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.TAXONOMY, {"mode": "FAILFAST"}).alias("t")).select("t.*")


def format_taxonomy(topics: DataFrame, max_terms: int = 5) -> str:
    """The tree as indented lines, for a console: a taxonomy is small."""
    rows = topics.select("id", "canonical_name", "parent_topic_id", "terms").orderBy("canonical_name", "id").collect()
    below: dict[str | None, list] = {}
    for r in rows:
        below.setdefault(r.parent_topic_id, []).append(r)
    lines, todo = [], [(r, 0) for r in reversed(below.get(None, []))]
    while todo:
        r, depth = todo.pop()
        shown = ", ".join(r.terms[:max_terms]) + (f" and {len(r.terms) - max_terms} more" if len(r.terms) > max_terms else "")
        lines.append(f"{'  ' * depth}- {r.canonical_name}: {shown}")
        todo += [(x, depth + 1) for x in reversed(below.get(r.id, []))]
    return "\n".join(lines)


def clusters_for_display(labelled: DataFrame) -> DataFrame:
    """(cluster_id, size, members: (id, text) by id), largest first."""
    grouped = labelled.groupBy("cluster_id").agg(F.count("*").alias("size"), F.array_sort(F.collect_list(F.struct("id", "text"))).alias("members"))
    return grouped.orderBy(F.desc("size"), "cluster_id")


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many partitions as there are cores, if a file of one row group has come in fewer; else as it is, without a shuffle. The rows are the same."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """The rows over all cores, for work that is long for the bytes it reads: by bytes alone they might be one task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
