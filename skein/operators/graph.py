"""Graph operators over ``entities`` and ``edges`` (a bag: equal edges count each).

Traversals take many starts at once and run a frontier loop: one join and one
partial aggregate per hop, an anti-join against what was seen, and a written
table as the cut. Paths are never enumerated.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.storage import cut

#: Walks end where nothing new is reached.
UNLIMITED = sys.maxsize - 1
#: Hops after which what was seen is one table again.
COMPACT = 8


def fan_out(edges: DataFrame, entity_id: str) -> DataFrame:
    return edges.where(F.col("src") == entity_id)


def fan_in(edges: DataFrame, entity_id: str) -> DataFrame:
    return edges.where(F.col("dst") == entity_id)


def fan_counts(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_id, fan_in, fan_out) for every entity."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("entity_id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("entity_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    sums = ends.groupBy("entity_id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return entities.select("entity_id").join(sums, "entity_id", "left").fillna(0, ["fan_in", "fan_out"])


def _steps(edges: DataFrame, undirected: bool) -> DataFrame:
    """(at, to, forth, kind): one row per pair of neighbours, with the smallest edge between them, which runs from ``at`` if ``forth``.

    Undirected, a pair is grouped once for both ways, and nothing repeats its ends."""
    some = edges.where("src <> dst")
    if not undirected:
        return some.groupBy(F.col("dst").alias("at"), F.col("src").alias("to")).agg(F.min(F.struct("kind")).alias("e")).select("at", "to", F.lit(False).alias("forth"), "e.kind")
    turned = (F.col("src") > F.col("dst")).alias("turned")  # an edge from the smaller end is the smaller one
    pairs = some.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min(F.struct(turned, "kind")).alias("e"))
    both = F.explode(F.array(F.struct(F.col("a").alias("at"), F.col("b").alias("to"), (~F.col("e.turned")).alias("forth")), F.struct(F.col("b").alias("at"), F.col("a").alias("to"), F.col("e.turned").alias("forth"))))
    return pairs.select(both.alias("x"), F.col("e.kind").alias("kind")).select("x.*", "kind")


def _via() -> Column:
    """A step's edge."""
    at, to = F.col("at"), F.col("to")
    return F.struct(F.when(F.col("forth"), at).otherwise(to).alias("src"), F.when(F.col("forth"), to).otherwise(at).alias("dst"), "kind")


def _walk(edges: DataFrame, starts: DataFrame, depth: int, undirected: bool) -> DataFrame:
    steps = cut(_steps(edges, undirected), "steps")
    frontier = starts.select(F.col("entity_id").alias("start_id"), F.col("entity_id").alias("at")).distinct()
    seen = frontier.select("start_id", F.col("at").alias("entity_id"), F.lit(0).alias("depth"), F.lit(None).cast("struct<src:string,dst:string,kind:string>").alias("via"))
    seen = cut(seen, "walk")
    for d in range(1, depth + 1):
        reached = frontier.join(steps, "at").groupBy("start_id", F.col("to").alias("entity_id")).agg(F.min(_via()).alias("via"))
        new = reached.join(seen.select("start_id", "entity_id"), ["start_id", "entity_id"], "left_anti")
        new = cut(new.select("start_id", "entity_id", F.lit(d).alias("depth"), "via"), "hop")
        if new.isEmpty():
            break
        seen = seen.union(new)
        if d % COMPACT == 0:
            seen = cut(seen, "walk")
        frontier = new.select("start_id", F.col("entity_id").alias("at"))
    return seen.where("depth > 0")


def related(entities: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(start_id, entity_id, depth, via) within ``depth`` undirected hops (0 or less: 2); dangling ends are left out."""
    found = _walk(edges, starts, depth if depth > 0 else 2, undirected=True)
    return found.join(entities.select("entity_id"), "entity_id", "left_semi").select("start_id", "entity_id", "depth", "via")


def upstream(entities: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 0) -> DataFrame:
    """(start_id, entity_id, depth, via) of what leads to each start along edges; 0 or less: the whole closure."""
    found = _walk(edges, starts, depth if depth > 0 else UNLIMITED, undirected=False)
    return found.join(entities.select("entity_id"), "entity_id", "left_semi").select("start_id", "entity_id", "depth", "via")


def shortest_path(entities: DataFrame, edges: DataFrame, start: str, target: str) -> DataFrame:
    """(depth, entity_id, via) from the first hop to ``target``; empty if there is none, or if it is ``start``."""
    spark = edges.sparkSession
    none = spark.createDataFrame([], "depth int, entity_id string, via struct<src:string,dst:string,kind:string>")
    known = entities.where(F.col("entity_id").isin(start, target)).select("entity_id").distinct().count()
    if start == target or known < 2:
        return none
    steps = cut(_steps(edges, True), "steps")
    frontier = spark.createDataFrame([(start,)], "at string")
    seen = cut(frontier.select(F.col("at").alias("entity_id"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit(None).cast("struct<src:string,dst:string,kind:string>").alias("via")), "walk")
    hops = []
    for d in range(1, UNLIMITED):
        reached = frontier.join(steps, "at").groupBy(F.col("to").alias("entity_id")).agg(F.min(F.struct("at", _via().alias("via"))).alias("by"))
        new = reached.join(seen.select("entity_id"), "entity_id", "left_anti").select("entity_id", F.col("by.at").alias("parent"), F.lit(d).alias("depth"), F.col("by.via").alias("via"))
        new = cut(new, "hop")
        if new.isEmpty():
            return none
        hops.append(new)
        if not new.where(F.col("entity_id") == target).isEmpty():
            break
        seen = seen.select("entity_id").union(new.select("entity_id"))
        if d % COMPACT == 0:
            seen = cut(seen, "walk")
        frontier = new.select(F.col("entity_id").alias("at"))
    path, at = [], target
    for hop in reversed(hops):  # one lookup, in one hop's table, per step of the path found
        row = hop.where(F.col("entity_id") == at).first()
        path.append((row.depth, row.entity_id, row.via))
        at = row.parent
    return spark.createDataFrame(path[::-1], none.schema)


def impact(entities: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start_id, entity_id, depth, direct, is_test): callers of each start, all the way up."""
    up = upstream(entities, edges, starts)
    kinds = entities.select("entity_id", (F.col("kind") == "Test").alias("is_test")).distinct()
    return up.join(kinds, "entity_id").select("start_id", "entity_id", "depth", (F.col("depth") == 1).alias("direct"), "is_test")


def changed_entities(entities: DataFrame, ranges: DataFrame) -> DataFrame:
    """Entities whose lines overlap a changed range of their file; ``ranges`` has (file, s, e). An equi-join on file with a range residual."""
    r = ranges.select(F.col("file").alias("_file"), "s", "e")
    return entities.join(r, (F.col("file") == F.col("_file")) & (F.col("start_line") <= F.col("e")) & (F.col("s") <= F.col("end_line")), "left_semi")


def remove_entities(entities: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without ``gone`` (entity_id); edges go from either end."""
    ids = gone.select("entity_id").distinct()
    kept = edges.join(ids, edges.src == ids.entity_id, "left_anti")
    return entities.join(ids, "entity_id", "left_anti"), kept.join(ids, kept.dst == ids.entity_id, "left_anti")


def drop_dangling(entities: DataFrame, edges: DataFrame, self_loops: bool = False) -> DataFrame:
    """``entities`` as it is: a semi-join needs no distinct ids, which a task would gather in memory."""
    ids = entities.select("entity_id")
    kept = edges.join(ids, edges.src == ids.entity_id, "left_semi")
    kept = kept.join(ids, kept.dst == ids.entity_id, "left_semi")
    return kept if self_loops else kept.where("src <> dst")


def diff_hunks(lines: DataFrame) -> DataFrame:
    """(file, s, e) of the changed ranges of a unified diff without context; ``lines`` has (diff_id, pos, line).

    The file of a hunk is the last ``+++`` line before it; a diff is one group of a running window.
    """
    from pyspark.sql import Window

    target = F.regexp_extract("line", r"^\+\+\+ (?:b/)?(.*)$", 1)
    file = F.when(F.col("line").startswith("+++ "), F.regexp_replace(target, r"\s+$", ""))
    order = Window.partitionBy("diff_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = lines.withColumn("file", F.last(file, ignorenulls=True).over(order))
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    hunks = at.where(F.col("line").rlike(hunk) & (F.col("file") != "/dev/null"))
    start = F.regexp_extract("line", hunk, 1).cast("int")
    count = F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(line, r'{hunk}', 2), '') as int)"), F.lit(1))
    return hunks.select("diff_id", "file", start.alias("s"), F.greatest(start, start + count - 1).alias("e"))
