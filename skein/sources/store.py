"""Snapshots and small state: versioned Parquet directories behind a pointer file."""

from __future__ import annotations

import json
import os
import time
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.identity import repo_state_name
from skein.operators import graph
from skein.schemas import FORMAT_VERSION

DECISIONS = ("undecided", "duplicate", "intentional", "false-positive", "refactor-later")
TABLES = ("entities", "edges", "dispositions", "files", "refs", "imports", "reexports", "ext_methods", "field_types", "targets")


class BadSnapshot(ValueError):
    pass


def state_dir(warehouse: str, root: str) -> str:
    return f"{warehouse.rstrip('/')}/{repo_state_name(os.path.abspath(root))}"


def _pointer(directory: str) -> str:
    return f"{directory}/CURRENT.json"


def _replace_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file wherever Spark writes, put in place by one rename."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    target, fresh = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    out = fresh.getFileSystem(conf).create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fresh.getFileSystem(conf).getUri(), conf).rename(fresh, target, over)


def write_snapshot(directory: str, repo: str, tables: dict[str, DataFrame]) -> str:
    """Write all tables beside the current version, then switch the pointer, which lies beside them, in one rename; dangling edges are left out."""
    version = f"v{time.time_ns()}-{uuid.uuid4().hex[:6]}"
    for name, df in tables.items():
        if name == "edges":
            df = graph.drop_dangling(tables["entities"], df, self_loops=True)
        if name == "entities":
            df = df.repartitionByRange("entity_id").sortWithinPartitions("entity_id")
        df.write.parquet(f"{directory}/{version}/{name}")
    meta = {"format": FORMAT_VERSION, "repo": repo, "version": version, "tables": sorted(tables)}
    _replace_text(next(iter(tables.values())).sparkSession, _pointer(directory), json.dumps(meta))
    return version


class Snapshot:
    def __init__(self, spark: SparkSession, directory: str):
        try:
            self.meta = json.loads(spark.read.text(_pointer(directory), wholetext=True).first().value)
        except (PySparkException, Py4JJavaError, AttributeError, ValueError) as e:
            raise BadSnapshot(f"no snapshot in {directory}") from e
        if self.meta.get("format") != FORMAT_VERSION:
            raise BadSnapshot(f"format {self.meta.get('format')}, expected {FORMAT_VERSION}")
        self.spark, self.base = spark, f"{directory}/{self.meta['version']}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}")

    @property
    def entities(self) -> DataFrame:
        return self.table("entities")

    @property
    def edges(self) -> DataFrame:
        return self.table("edges")

    def all(self) -> DataFrame:
        return self.entities.orderBy("entity_id")

    def lookup(self, entity_id: str):
        """Files of ascending ranges of entity_id let Parquet's statistics skip all but one."""
        return self.entities.where(F.col("entity_id") == entity_id).first()


class JsonState:
    """A small keyed state file on the driver; absent or unreadable counts as empty, writes are atomic."""

    def __init__(self, path: str):
        self.path = Path(path)

    def load(self) -> dict:
        try:
            return json.loads(self.path.read_text())
        except (OSError, ValueError):
            return {}

    def save(self, value: dict) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        fresh = self.path.with_name(f".{uuid.uuid4().hex}")
        fresh.write_text(json.dumps(value, indent=1, sort_keys=True))
        fresh.replace(self.path)


class Decisions(JsonState):
    def decide(self, a: str, b: str, decision: str) -> None:
        if decision not in DECISIONS:
            raise ValueError(f"{decision!r} is none of {', '.join(DECISIONS)}")
        self.save(self.load() | {"_".join(sorted((a, b))): decision})

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.load().items()), "pair_key string, decision string")


class Ledger(JsonState):
    """Delivered entities of a session: handle numbers and highest levels."""

    def table(self, spark: SparkSession, session: str) -> DataFrame:
        rows = [(session, e, x["handle"], x["level"]) for e, x in sorted(self.load().items())]
        return spark.createDataFrame(rows, "session_id string, entity_id string, handle_no int, level int")

    def store(self, ledger: DataFrame) -> None:
        self.save({r.entity_id: {"handle": r.handle_no, "level": r.level} for r in ledger.collect()})


class Projects(JsonState):
    """Registered projects by name."""

    def add(self, name: str, path: str) -> None:
        full = os.path.abspath(path)
        if not os.path.isdir(full):
            raise NotADirectoryError(full)
        self.save(self.load() | {name: full})

    def remove(self, name: str) -> None:
        self.save({k: v for k, v in self.load().items() if k != name})

    def list(self) -> list[tuple[str, str]]:
        return sorted(self.load().items())

    def resolve(self, name_or_path: str) -> str:
        return self.load().get(name_or_path, name_or_path)


def reconcile(running: DataFrame, registered: DataFrame) -> DataFrame:
    """(name, action): start, stop, restart or keep, from (name, root) and (name, path)."""
    both = running.join(registered, "name", "full_outer")
    action = F.when(F.col("path").isNull(), "stop").when(F.col("root").isNull(), "start").when(F.col("root") != F.col("path"), "restart").otherwise("keep")
    return both.select("name", action.alias("action"))


def load_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(fixture, id, prompt, gold_files, grep_steps) of a task-set file; an empty set is an error."""
    task = "struct<id:string,prompt:string,gold_files:array<string>,grep_steps:array<struct<pattern:string,note:string>>>"
    sets = spark.read.schema(f"fixture string, tasks array<{task}>").json(path, multiLine=True)
    tasks = sets.select("fixture", F.explode("tasks").alias("t")).select("fixture", "t.*")
    if tasks.isEmpty():
        raise ValueError(f"{path} has no tasks")
    return tasks
