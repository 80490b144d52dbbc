"""Cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.environ.get("TEXTLOOM_LOCAL_CHECKPOINTS") or os.environ.setdefault("TEXTLOOM_LOCAL_CHECKPOINTS", tempfile.mkdtemp(prefix="textloom"))
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes a table in the shared folder and reads it, so no lost executor can take it away."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that `store` left in the shared folder; only when no result that reads them is in use."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/textloom")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(taken: list[str], *names: str) -> list[str]:
    """These names, each lengthened until no column of the caller's has it."""
    lower, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in lower:
            name += "_"
        lower.add(name.lower())
        out.append(name)
    return out
