"""Where embeddings come from. No provider here needs a network; a remote one is a CallableEmbedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import clean_for_embedding, normalize_tokens


class Embedding(Protocol):
    def embed(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """The rows with a column embedding."""
        ...


@dataclass(frozen=True)
class HashingEmbedding:
    """Signed feature hashing of normalised tokens, of unit length: deterministic. A token's slot and sign are digits of its MD5."""

    dim: int = 64

    def embed(self, rows: DataFrame, text: str = "text") -> DataFrame:
        dim, names = self.dim, rows.columns
        digits = lambda t, at, n: F.conv(F.substring(F.md5(t.cast("binary")), at, n), 16, 10).cast("long")
        code = lambda t: (digits(t, 1, 7) % dim + 1) * F.when(digits(t, 8, 1) % 2 == 0, 1).otherwise(-1)
        coded = rows.select("*", F.transform(normalize_tokens(F.col(text)), code).alias("_tl_codes"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    part = b.slice(at, 4096)
                    lists = pc.fill_null(part.column("_tl_codes"), [])
                    n = np.asarray(pc.list_value_length(lists)).astype(np.int64)
                    c = np.asarray(lists.flatten()).astype(np.int64)
                    row = np.repeat(np.arange(len(n)), n)
                    x = np.bincount(row * dim + np.abs(c) - 1, np.sign(c), len(n) * dim).reshape(len(n), dim)
                    norm = np.sqrt((x * x).sum(1))[:, None]
                    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(names))], pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * dim, pa.int32()), pa.array(x.ravel()))], [*names, "embedding"])

        return coded.mapInArrow(run, T.StructType([*rows.schema, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


@dataclass(frozen=True)
class TableEmbedding:
    """Looked up by a key column in a table of (key, embedding)."""

    table: DataFrame
    key: str

    def embed(self, rows: DataFrame, text: str = "text") -> DataFrame:
        return rows.join(self.table.select(self.key, "embedding"), self.key, "left")


@dataclass(frozen=True)
class CallableEmbedding:
    """A function of a list of texts, called a batch at a time; as many calls run at once as there are partitions."""

    call: Callable[[list[str]], list[list[float]]]
    concurrency: int = 12
    batch: int = 64

    def embed(self, rows: DataFrame, text: str = "text") -> DataFrame:
        call, size = self.call, self.batch

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, size):
                    part = b.slice(at, size)
                    vectors = call(part.column(text).to_pylist())
                    if len(vectors) != part.num_rows:
                        raise ValueError("an embedding for each text is needed")
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], [*part.schema.names, "embedding"])

        schema = T.StructType([*rows.schema, T.StructField("embedding", T.ArrayType(T.FloatType()))])
        return rows.repartition(self.concurrency).mapInArrow(run, schema)


def embed_distinct(rows: DataFrame, provider: Embedding, text: str = "text") -> DataFrame:
    """(text, embedding): each distinct text is embedded once, cleaned; a null text isn't, an empty one is an error."""
    texts = rows.select(F.col(text).alias("text")).where("text is not null").distinct()
    return provider.embed(texts.select("text", clean_for_embedding(F.col("text")).alias("_tl_clean")), "_tl_clean").drop("_tl_clean")


def embed_missing(rows: DataFrame, provider: Embedding, text: str = "text") -> DataFrame:
    """The rows, those without an embedding with one of their cleaned text; others keep theirs. An empty text is an error, a null one has no embedding."""
    lacking = rows.where(F.col("embedding").isNull() & F.col(text).isNotNull()).drop("embedding").withColumn("_tl_clean", clean_for_embedding(F.col(text)))
    rest = rows.where(F.col("embedding").isNotNull() | F.col(text).isNull())
    return rest.unionByName(provider.embed(lacking, "_tl_clean").select(*rest.columns))
