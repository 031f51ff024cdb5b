"""Reliable cuts of lineage and versioned table directories."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skein-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and reread, so that loops keep short plans and survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/skein-{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str, rows: int = 2_000) -> DataFrame:
    """``df`` dealt by ``key`` over tasks of about ``rows`` rows: for small rows that cost much, which Spark would leave to the few tasks that read them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)), key)


def broadcast_if_small(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """A broadcast hint for a side whose row count is known and small; otherwise the planner decides."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if rows <= most else df
