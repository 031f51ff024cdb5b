"""Change feeds: debounced batches of changed paths, incremental re-indexing per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUIET = "300 milliseconds"


def debounce(changes: DataFrame, quiet: str = QUIET) -> DataFrame:
    """(project, began, ended, events, paths): bursts of changes that a quiet period ends. For batches and streams of (project, ts, path)."""
    session = F.session_window("ts", quiet)
    found = changes.groupBy("project", session.alias("burst")).agg(F.count(F.lit(1)).alias("events"), F.sort_array(F.collect_set("path")).alias("paths"))
    return found.select("project", F.col("burst.start").alias("began"), F.col("burst.end").alias("ended"), "events", "paths")


def change_stream(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, ts, content) of files that appear under ``root``; a changed file appears again under a new name or time."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return files.schema("path string, modificationTime timestamp, length long, content binary").load(root).select("path", F.col("modificationTime").alias("ts"), "content")


def run_incremental(stream: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Start ``update(batch, batch_id)`` per micro-batch. A failed batch is tried again from the checkpoint, a slow one lets changes gather: nothing is dropped."""
    writer = stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
