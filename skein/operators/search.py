"""Lookup over entity tables: exact, tiered substring, unique, browsing, grep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = 25


class NotUnique(LookupError):
    pass


def find(entities: DataFrame, name: str) -> DataFrame:
    """By qualified name if ``name`` holds a ``#``, else by name; in id order."""
    column = "qualified" if "#" in name else "name"
    return entities.where(F.col(column) == name).orderBy("entity_id")


def suggest(entities: DataFrame, query: str, kind: str | None = None, limit: int = 8) -> DataFrame:
    """Names holding ``query``: equal (tier 0), beginning with it (1), holding it (2). A limit of 0 or less takes all."""
    q = query.strip().lower()
    low = F.lower("name")
    hits = entities.where(F.lit(bool(q)) & (F.instr(low, q) > 0)) if q else entities.limit(0)
    if kind:
        hits = hits.where(F.col("kind") == kind)
    tier = F.when(low == q, 0).when(low.startswith(q), 1).otherwise(2)
    ordered = hits.withColumn("tier", tier).orderBy("tier", "name", "file", "entity_id")
    return ordered.limit(limit) if limit > 0 else ordered


def find_unique(entities: DataFrame, name: str, file_part: str = ""):
    """The one entity of that name (in a file whose path holds ``file_part``); two rows at most reach the driver."""
    hits = entities.where(F.col("name") == name)
    if file_part:
        hits = hits.where(F.col("file").contains(file_part))
    rows = hits.take(2)
    if len(rows) != 1:
        raise NotUnique(f"{'no' if not rows else 'more than one'} entity named {name!r}")
    return rows[0]


def browse(entities: DataFrame, query: str = "", kind: str | None = None, page: int = 0, size: int = PAGE) -> DataFrame:
    q = query.lower()
    hits = entities.where(F.lower("name").contains(q) | F.lower("qualified").contains(q)) if q else entities
    if kind:
        hits = hits.where(F.col("kind") == kind)
    return hits.orderBy("name", "entity_id").offset(page * size).limit(size)


def filter_pairs(pairs: DataFrame, query: str) -> DataFrame:
    q = query.lower()
    fields = ("a_name", "a_qualified", "b_name", "b_qualified")
    hit = F.lit(not q)
    for f in fields:
        hit = hit | F.lower(f).contains(q)
    return pairs.where(hit)


def grep(files: DataFrame, pattern: str) -> DataFrame:
    """(path, line, text) of every line that ``pattern`` (Java syntax) finds; ``files`` has (path, text)."""
    lines = files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    return lines.where(F.col("text").rlike(pattern)).select("path", (F.col("pos") + 1).alias("line"), "text")
