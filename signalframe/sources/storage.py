"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, kind: str, tag: str) -> str:
    """A new path under spark.checkpoint.dir.

    Without that setting a local folder serves, which is right for a local master only.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return f"{(named or f'file://{tempfile.gettempdir()}/checkpoints').rstrip('/')}/{kind}/{tag}-{uuid.uuid4().hex}"


def settled(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: computed once, lineage cut."""
    path = shared_path(df.sparkSession, "settled", tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
