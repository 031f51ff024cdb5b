"""Mixing sources to target weights: Sainte-Lague quotas of single words.

A source's target is its weighted share of ``share`` times all words, stopped
at ``cap`` times its own size; what a stopped source leaves is shared again by
weight until none is above. Targets become integer quotas of words by
Sainte-Lague: each next word goes to the source with the highest quotient
target / (2 * words so far + 1). Only the last few are dealt one by one, so
the unit need not grow with the corpus, and a source takes its target to
within a word or so at any size. A source is dealt over shards of about
``SHARD_WORDS`` words by a seeded hash, and the source's quota is apportioned over
its shards the same way, by shard size: down a tree of at most ``FAN`` children a
node, so that no step sees more than ``FAN`` claims, whatever the number of shards.

Within a shard documents stand in seeded hash order, and their words form one
stream. ``quota div size`` full passes are taken, and the remaining words are
the seeded circular run that starts at a hashed word; as the order is a hash
order, that run is a seeded sample of documents, and only the documents at its
ends are cut. Rows that repeat (doc_id, text and source) are one entry with a
number of copies, which stand in the stream one after the other.

Only one row per source reaches the driver (more than ``max_sources`` are refused
with an error); shards stay in tables. Documents are shuffled as (id, size) rows.

Defined cases. Null text has size 0. Null source is a source of its own, last.
Empty tables give empty results; sources without words get target 0 and take
nothing. Rows that repeat are separate rows of the mix, each with its own part;
which of several equal rows gets which part is open. ``emit`` returns the columns
of its input, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm._store import materialize, partitions, text_key
from skein.session import table

WORD = r"[^\x20\x09-\x0D]+"
SHARD_WORDS, FAN = 250_000, 1024
#: Copies of one row that a task unfolds.
COPIES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Weighted shares of ``share * sum(sizes)``, none above ``cap`` times its size."""
    targets, open_ = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    left = share * sum(sizes)
    while open_:
        per = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if per * weights[i] > cap * sizes[i]]
        for i in over or open_:
            targets[i] = cap * sizes[i] if over else per * weights[i]
        if not over:
            break
        left -= sum(targets[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def sainte_lague(claims: Sequence[float], seats: int, limits: Sequence[int]) -> list[int]:
    """Seats by highest quotient claim / (2 * seats + 1); ties go to the earlier claim, full claims get no more."""
    got = [0] * len(claims)
    total = sum(claims)
    if total <= 0 or seats <= 0:
        return got
    # all quotients of at least half this divisor win, at most ``seats`` of them; the rest, about one a claim, go one by one
    sure = seats - sum(c > 0 for c in claims) / 2
    divisor = total / sure * (1 + 1e-12) if sure > 0 else math.inf
    got = [min(limit, math.floor(c / divisor + 0.5)) for c, limit in zip(claims, limits, strict=True)]
    heap = [(-c / (2 * n + 1), i) for i, (c, n) in enumerate(zip(claims, got, strict=True)) if c > 0 and n < limits[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < limits[i]:
            heapq.heappush(heap, (-claims[i] / (2 * got[i] + 1), i))
    return got


def shard_quotas(shards: DataFrame, quotas: DataFrame, most: int, cap: int) -> DataFrame:
    """(sid, shard, n, full, extra) from rows (sid, shard, n) and (sid, quota); ``most``: shards of the largest source."""
    levels = 1
    while FAN**levels < most:
        levels += 1

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("child", ignore_index=True)
        sizes = pdf["n"].tolist()
        return pdf.assign(quota=sainte_lague(sizes, int(pdf["quota"].iloc[0]), [cap * n for n in sizes]))[["sid", "child", "n", "quota"]]

    nodes = quotas.select("sid", F.lit(0).cast("long").alias("child"), "quota")
    for level in range(levels - 1, -1, -1):
        child, parent = F.floor(F.col("shard") / FAN**level), F.floor(F.col("shard") / FAN ** (level + 1))
        sizes = shards.groupBy("sid", child.alias("child"), parent.alias("parent")).agg(F.sum("n").alias("n"))
        above = nodes.select("sid", F.col("child").alias("parent"), "quota")
        nodes = sizes.join(above, ["sid", "parent"]).groupBy("sid", "parent").applyInPandas(deal, "sid int, child long, n long, quota long")
    return nodes.select(
        "sid", F.col("child").alias("shard"), "n", F.when(F.col("n") > 0, F.expr("quota div n")).otherwise(F.lit(0)).alias("full"),
        F.when(F.col("n") > 0, F.col("quota") % F.col("n")).otherwise(F.lit(0)).alias("extra"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
    seed: int = 7,
    max_sources: int = 1_000_000,
) -> DataFrame:
    """(doc_id, tk, source, copy, copies, size, source_size, target, taken, full, cut_from, cut_to, cut_from2, cut_to2) per row of ``docs``.

    A row is taken ``full`` times whole, and once more the words [cut_from, cut_to) and [cut_from2, cut_to2).
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_key().alias("tk"), "source", word_count(F.col("text")).alias("size"))
    sized = materialize(rows.groupBy("doc_id", "tk", "source", "size").agg(F.count(F.lit(1)).alias("copies")), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n")).limit(max_sources + 1).collect()
    if len(per_source) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    found = sorted(((r.source, r.n) for r in per_source), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n for _, n in found]
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, cap)
    quotas = sainte_lague(targets, round(sum(targets)), [cap * n for n in sizes])
    plan = spark.createDataFrame(
        [(i, s, n, float(t), max(1, n // SHARD_WORDS), q) for i, ((s, n), t, q) in enumerate(zip(found, targets, quotas, strict=True))],
        "sid int, psource string, source_size long, target double, shards long, quota long",
    )
    dealt = sized.join(plan.drop("quota"), F.col("source").eqNullSafe(F.col("psource"))).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "tk"), F.col("shards")))
    shards = materialize(dealt.groupBy("sid", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("n")), "mix-shards")
    picked = materialize(shard_quotas(shards, plan.select("sid", "quota"), max([1, *(n // SHARD_WORDS for n in sizes)]), cap), "mix-quotas")
    order = Window.partitionBy("sid", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "tk"), "doc_id", "tk", "size")
    placed = dealt.withColumn("to", F.sum(F.col("size") * F.col("copies")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("from", F.col("to") - F.col("size") * F.col("copies")).join(picked, ["sid", "shard"])
    # the circular run of extra words: [lo, hi), and what wraps round: [0, wrap)
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "sid", "shard"), F.greatest(F.col("n"), F.lit(1)))
    placed = placed.withColumn("lo", start).withColumn("end", start + F.col("extra"))
    placed = placed.withColumn("hi", F.least("end", "n")).withColumn("wrap", F.greatest(F.col("end") - F.col("n"), F.lit(0)))
    placed = materialize(placed.select("doc_id", "tk", "source", "copies", "size", "source_size", "target", "full", "from", "lo", "hi", "wrap"), "mix-places")
    alone = placed.where(F.col("copies") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    # a row of very many copies is unfolded by many tasks
    many = placed.where(F.col("copies") > COPIES).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    many = many.repartition(partitions(spark), "doc_id", "tk", "part").withColumn(
        "copy", F.explode(F.sequence(F.col("part"), F.least(F.col("part") + COPIES, F.col("copies")) - 1))
    )
    every = alone.unionByName(many.drop("part")).withColumn("from", F.col("from") + F.col("copy") * F.col("size"))

    def inside(at: Column) -> Column:
        return F.least(F.greatest(at - F.col("from"), F.lit(0)), F.col("size"))

    cut = every.select(
        "doc_id", "tk", "source", "copy", "copies", "size", "source_size", "target", "full",
        F.lit(0).cast("long").alias("cut_from"), inside(F.col("wrap")).alias("cut_to"),
        inside(F.col("lo")).alias("cut_from2"), F.greatest(inside(F.col("hi")), inside(F.col("lo"))).alias("cut_to2"),
    )
    taken = F.col("size") * F.col("full") + F.col("cut_to") - F.col("cut_from") + F.col("cut_to2") - F.col("cut_from2")
    return cut.withColumn("taken", taken)


def emit(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as taken; a cut row holds the taken words only."""
    own = docs.columns
    # whatever the columns are called, they travel in one
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col("doc_id").alias("d"), text_key().alias("k"), F.col("source").alias("s"), F.col("text").alias("t")
    )
    a, b = (lambda lo, hi: F.struct(F.col(lo).alias("a"), F.col(hi).alias("b")))("cut_from", "cut_to"), F.struct(F.col("cut_from2").alias("a"), F.col("cut_to2").alias("b"))
    side = mixed.select("doc_id", "tk", "source", "copy", "copies", "size", "full", F.array(a, b).alias("cuts"))
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("tk")) & F.col("s").eqNullSafe(F.col("source"))
    joined = keyed.join(side.where("copies = 1"), same).select("row", "t", "size", "full", "cuts")
    repeated = side.where("copies > 1")
    if not repeated.isEmpty():
        # equal rows are numbered inside the partitions of a written table, then over these
        rows = keyed.join(repeated.where("copy = 0").select("doc_id", "tk", "source"), same).select("row", "d", "k", "s", "t", F.spark_partition_id().alias("p"))
        rows = materialize(rows, "repeated-rows")
        sizes = rows.groupBy("d", "k", "s", "p").agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.partitionBy("d", "k", "s").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        bases = sizes.select(F.col("d").alias("bd"), F.col("k").alias("bk"), F.col("s").alias("bs"), F.col("p").alias("bp"), before.alias("base"))
        local = rows.withColumn("i", F.row_number().over(Window.partitionBy("d", "k", "s", "p").orderBy(F.lit(0))) - 1)
        at = local.join(bases, F.col("d").eqNullSafe(F.col("bd")) & (F.col("k") == F.col("bk")) & F.col("s").eqNullSafe(F.col("bs")) & (F.col("p") == F.col("bp")))
        at = at.withColumn("at", F.col("base") + F.col("i"))
        joined = joined.union(at.join(repeated, same & (F.col("at") == F.col("copy"))).select("row", "t", "size", "full", "cuts"))
    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("a"), F.col("size").alias("b")), F.col("full").cast("int"))
    pieces = F.filter(F.concat(whole, "cuts"), lambda x: x["b"] > x["a"])
    words = F.regexp_extract_all("t", F.lit(f"({WORD})"), F.lit(1))
    out = joined.withColumn("piece", F.explode(pieces))
    a, b = F.col("piece.a").cast("int"), F.col("piece.b").cast("int")
    text = F.when((a == 0) & (b == F.col("size")), F.col("t")).otherwise(F.array_join(F.slice(words, a + 1, b - a), " "))
    return out.select(*((text if c == "text" else F.col("row").getField(c)).alias(c) for c in own))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")
