"""Session construction and table access shared by every entry point."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold on any cluster; sizes of memory and parallelism come from the submitter.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, app: str = "skein", **conf: str) -> SparkSession:
    """A local session for tests, the bench and the command line."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if here not in os.environ.get("PYTHONPATH", "").split(os.pathsep):  # Python workers import this package
        os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (here, os.environ.get("PYTHONPATH"))))
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": os.environ.get("SKEIN_DRIVER_MEMORY", "8g"),
        "spark.driver.host": "127.0.0.1",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    session = builder.config(map=settings | conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
