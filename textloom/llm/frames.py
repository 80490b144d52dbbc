"""What the operators share on the DataFrame side."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.shared import fresh, store  # noqa: F401

from . import kernels as K

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_passes(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text", limit: int = K.PASS_BYTES) -> DataFrame:
    """mapInArrow in passes of bounded bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.passes(batch, text, limit):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def map_keyed(df: DataFrame, key: str, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, least: int = 1, order: tuple[str, ...] = ()) -> DataFrame:
    """Calls work with tables of whole key groups, sorted by key; many small groups share a call.

    One shuffle and one sort. A call gets at least `least` rows where there are as many, and never part of a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < least:
                continue
            last = batch.column(key)[batch.num_rows - 1].as_py()
            if held[0].column(key)[0].as_py() == last:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            held, batch, rest = [], None, None  # else their rows are held twice while work runs
            keys = whole.column(key).combine_chunks()
            keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
            cut = rows - 1
            step = 1
            while cut >= 0 and keys[cut].as_py() == last:  # gallops back to the start of the last group
                cut -= step
                step *= 2
            low, high = max(cut, -1), min(cut + step // 2, rows - 1) if step > 1 else rows - 1
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (low, middle) if keys[middle].as_py() == last else (middle, high)
            cut = low + 1
            if cut > 0:
                yield from work(whole.slice(0, cut))
            rest = whole.slice(max(cut, 0))
            held, rows = [x for x in rest.to_batches() if x.num_rows], rest.num_rows
        if rows:
            whole = pa.Table.from_batches(held).combine_chunks()
            held, batch, rest = [], None, None
            yield from work(whole)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def batches_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)


def row_key(id_column: str = "doc_id", text: str = "text"):
    """A key of a row: equal only for rows that repeat both id and text."""
    return F.xxhash64(F.col(id_column), F.col(text))


def keep_rows(docs: DataFrame, decide: Callable[[pa.RecordBatch], np.ndarray], limit: int = K.PASS_BYTES) -> DataFrame:
    """The rows, all columns, for which decide says so; no shuffle and no join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.passes(batch, limit=limit):
                yield part.filter(pa.array(decide(part)))

    return docs.mapInArrow(run, docs.schema)
