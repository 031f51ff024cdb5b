"""Aggregates of index, store, retrieval benchmark and similarity evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.schemas import BUGS, DISPOSITIONS


def disposition_histogram(resolved: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return resolved.groupBy(*by, "disposition").agg(F.count(F.lit(1)).alias("n"))


def bug_rate(counts: DataFrame) -> DataFrame:
    """One row: share of bug dispositions in (disposition, n); 0 without rows."""
    bugs = F.sum(F.when(F.col("disposition").isin(*BUGS), F.col("n")).otherwise(0))
    return counts.agg(F.coalesce(F.try_divide(bugs.cast("double"), F.sum("n")), F.lit(0.0)).alias("bug_rate"))


def in_display_order(counts: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(d) for d in DISPOSITIONS]), F.col("disposition"))
    return counts.withColumn("place", place).orderBy("place").drop("place")


def stats_by_kind(entities: DataFrame) -> DataFrame:
    return entities.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


def behaviours(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, behaviour): set of ``KIND:target name`` (the id where the target is unknown)."""
    names = entities.select(F.col("entity_id").alias("dst"), "name").dropDuplicates(["dst"])
    named = edges.join(names, "dst", "left").select(F.col("src").alias("entity_id"), F.concat("kind", F.lit(":"), F.coalesce("name", "dst")).alias("b"))
    return named.groupBy("entity_id").agg(F.sort_array(F.collect_set("b")).alias("behaviour"))


def agreed_types(observations: DataFrame) -> DataFrame:
    """(file, var, type) where all observations of a variable in a file agree."""
    return observations.groupBy("file", "var").agg(F.min("type").alias("type"), F.count_distinct("type").alias("kinds")).where("kinds = 1").drop("kinds")


def retrieval_quality(items: DataFrame, gold: DataFrame) -> DataFrame:
    """Per task: recall of gold files, precision of items. ``items`` (task, file), ``gold`` (task, file)."""
    wanted = gold.select("task", "file").distinct()
    hit = items.join(wanted, ["task", "file"], "left_semi")
    covered = hit.groupBy("task").agg(F.count_distinct("file").alias("covered"), F.count(F.lit(1)).alias("hits"))
    sizes = wanted.groupBy("task").agg(F.count(F.lit(1)).alias("gold"))
    shown = items.groupBy("task").agg(F.count(F.lit(1)).alias("shown"))
    joined = sizes.join(shown, "task", "left").join(covered, "task", "left").fillna(0)
    return joined.select(
        "task", (F.col("covered") / F.col("gold")).alias("recall"), F.coalesce(F.try_divide(F.col("hits").cast("double"), "shown"), F.lit(0.0)).alias("precision")
    )


def benchmark_summary(tasks: DataFrame, least_reduction: float = 0.7, least_recall: float = 0.85) -> DataFrame:
    """One row over (recall, precision, tokens, baseline): averages, token reduction, pass."""
    reduction = 1 - F.try_divide(F.sum("tokens").cast("double"), F.sum("baseline"))
    out = tasks.agg(F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.sum("tokens").alias("tokens"), reduction.alias("reduction"))
    return out.withColumn("passed", (F.col("reduction") >= least_reduction) & (F.col("recall") >= least_recall))


def confusion(labelled: DataFrame) -> DataFrame:
    """One row over (flagged, want): tp, fp, fn, tn, precision, recall."""
    def count(flagged: bool, want: bool):
        return F.count_if((F.col("flagged") == flagged) & (F.col("want") == want))

    out = labelled.agg(count(True, True).alias("tp"), count(True, False).alias("fp"), count(False, True).alias("fn"), count(False, False).alias("tn"))
    return out.withColumn("precision", F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))).withColumn(
        "recall", F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    )


def merge_counts(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """Per-file counts after ``files`` were indexed again: theirs come from ``new``, all others stay."""
    return old.join(files.select("file").distinct(), "file", "left_anti").unionByName(new)


def baseline_tokens(gold: DataFrame, steps: DataFrame, files: DataFrame, count) -> DataFrame:
    """Per task: tokens of reading its gold files (oracle), of these and its search output (traced), and their ratio.

    ``gold`` (task, file), ``steps`` (task, pattern) with patterns in Java syntax, ``files`` (path, text); ``count`` maps
    a text column to its tokens. Every step searches all lines, so distinct patterns meet lines in a product; what a
    pattern finds is summed once and then counts for each task that has it.
    """
    whole = gold.select("task", "file").distinct().join(files, F.col("file") == F.col("path"))
    oracle = whole.groupBy("task").agg(F.sum(count(F.col("text"))).alias("oracle"))
    lines = files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    shown = F.concat("path", F.lit(":"), (F.col("pos") + 1).cast("string"), F.lit(": "), "line", F.lit("\n"))
    hits = lines.crossJoin(F.broadcast(steps.select("pattern").distinct())).where(F.regexp_like("line", F.col("pattern")))
    found = hits.withColumn("shown", shown).groupBy("pattern").agg(F.sum(count(F.col("shown"))).alias("found"))
    output = steps.select("task", "pattern").distinct().join(found, "pattern").groupBy("task").agg(F.sum("found").alias("searched"))
    both = oracle.join(output, "task", "left").withColumn("traced", F.col("oracle") + F.coalesce("searched", F.lit(0)))
    return both.select("task", "oracle", "traced", F.try_divide(F.col("traced").cast("double"), "oracle").alias("ratio"))


def estimator_ratio(texts: DataFrame, estimate, exact) -> DataFrame:
    """One row: estimated tokens over exact ones, over all texts (text)."""
    return texts.agg(F.try_divide(F.sum(estimate(F.col("text"))).cast("double"), F.sum(exact(F.col("text")))).alias("ratio"))


def same_entities(old: DataFrame, new: DataFrame) -> bool:
    """Whether both hold the same (entity_id, content_hash) rows, repeats included."""
    a, b = old.select("entity_id", "content_hash"), new.select("entity_id", "content_hash")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
