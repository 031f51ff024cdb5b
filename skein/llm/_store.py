"""Shared scratch tables: lineage is cut by writing Parquet to the folder all executors see."""

from __future__ import annotations

import functools
import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skein-"))
        base = spark.sparkContext.getCheckpointDir()
    base = base.rstrip("/")
    return base if "://" in base or base.startswith("file:") else f"file://{base}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/skein-{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a reliable cut of the lineage.

    A lost executor then costs a reread, not a recomputation, and the rows are
    the same for every later consumer.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def free_shuffles(spark: SparkSession) -> None:
    """Ask the driver to collect plans that are no longer held, so that Spark deletes their shuffle files now, not in half an hour.

    A plan is held by Python, by the gateway and by the JVM, one after the
    other, hence the rounds.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.25)


def discard(table: DataFrame) -> None:
    """Delete a scratch table that nothing reads any more."""
    path = getattr(table, "_scratch", None)
    if path:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def text_key(text: str = "text") -> Column:
    """Tells rows that share a doc_id but not a text apart when something is joined back to them."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows, and bytes, of a batch that goes to a Python worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def tuned(query):
    """``query`` with Arrow batches small enough for two tasks beside a small executor heap."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        for key, most in BATCH.items():
            now = spark.conf.get(key)
            if not now.isdigit() or int(now) > most:
                spark.conf.set(key, str(most))
        return query(spark, *args)

    return run
