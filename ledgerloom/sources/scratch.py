"""Folders and stored tables for steps of a job."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a table that is broadcast at most.
MAX_BROADCAST_ROWS = 100_000


def work_folder(spark: SparkSession, name: str = "stream") -> str:
    """A new folder in the cluster's shared checkpoint folder; a temporary one only in a local session where none is set."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(named or tempfile.mkdtemp()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a table in a work folder: what follows starts from there, also when executors are lost."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether df has so many rows at most; no more than these are counted."""
    return df.limit(rows + 1).count() <= rows


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its input has fewer splits than there are, for work that is dear in every row; larger inputs stay as they lie, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
