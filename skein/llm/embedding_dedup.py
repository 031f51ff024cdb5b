"""Embedding near-dedup: sorted projection passes.

Every pass draws its own random hyperplanes and orders the vectors of a label
lexicographically by the concatenated sign bits. Close vectors agree on most
bits, so in some pass they stand near each other; each vector is compared, in
double precision, with its next ``window`` neighbours in every pass, and the
verified pairs of all passes are united into components. Direct links are then
counted exactly inside each component, by blocks.

Recall. A label (and length) of at most ``exact`` classes is compared in full, by
blocks. In a larger one keys are taken of vectors less the label's mean m, so a
cone of vectors is spread out: a partner of x at the cosine c differs from it in
a bit with probability at most asin(d / |x - m|) / pi, d = sqrt(2 - 2c). It
surely meets x in a pass if it agrees on one bit more than x shares with the
ends of its window, which measures the density around x itself. The product over
all passes is x's chance to miss a partner; vectors above ``MISS`` go on to
further rounds of passes, among themselves, as a pair is found through either
end. What is left after ``ROUNDS`` rounds, as near its label's mean, is compared
in full. A pair counts if any chain of met pairs joins it.

Scale. Equal vectors are one class from the start (partial aggregate). A pass
sorts all vectors by one range shuffle, in which an order with neighbours
replaces buckets, so no bucket can overflow: a task compares ``block`` vectors
and the ``window`` before them, whatever the groups. A component of g vectors is
counted in blocks of g / 64 vectors (at least 64, at most 8,192): the pairs are
computed, but only one count per vector and block leaves a task.

Defined cases. Null label, null or empty vector, null or non-finite component,
or zero norm: no links, its own component. Vectors of different length are never
compared. Null vec_id: no links, component null, kept. Rows that repeat are
vectors of their own: twins link with each other. Ties take the smallest vec_id.
Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm._runs import run_bounds, runs
from skein.llm._store import free_shuffles, materialize, partitions
from skein.llm.components import connected_components
from skein.session import table

BITS = 48
#: A vector's greatest chance to miss a partner, and the rounds of passes before vectors above it are compared in full.
MISS, ROUNDS = 1e-4, 6


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as doubles of norm 1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows (vec_id, label, h1, h2) and classes of equal vectors (id, label, dim, n, h1, h2, embedding)."""
    x = F.col("embedding")
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0)
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    )
    rows = vectors.where(F.coalesce(usable, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit("second"), "embedding").alias("h2"), "embedding",
    )
    keys = rows.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"))
    own = rows.join(keys, ["label", "h1", "h2"]).where(F.col("vec_id") == F.col("id")).dropDuplicates(["label", "h1", "h2"])
    return rows.drop("embedding"), own.select("id", "label", F.size("embedding").alias("dim"), "n", "h1", "h2", "embedding")


def neighbour_links(classes: DataFrame, centres: DataFrame, cosine: float, passes: int, window: int, seed: int, block: int = 512) -> tuple[DataFrame, DataFrame]:
    """(a, b): pairs of classes that stand within ``window`` in some pass and reach ``cosine``, spanning per block; (id, lost): log chance to miss a partner.

    ``classes`` has (id, label, dim, embedding), ``centres`` (label, dim, centre).
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = np.diff(np.asarray(batch.column("embedding").offsets, np.int64))
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                x = _matrix(part.column("embedding")) - np.asarray(part.column("centre").flatten(), np.float64).reshape(part.num_rows, -1)
                far = np.sqrt((x * x).sum(1))
                same = np.where(far > reach, 1 - np.arcsin(np.minimum(1, reach / np.maximum(far, reach))) / np.pi, 0.0)
                for p in range(passes):
                    planes = np.random.default_rng((98, seed * passes + p, int(d))).standard_normal((int(d), BITS))
                    key = ((x @ planes) > 0) @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), part.column("label"), part.column("dim"), pa.array(key), part.column("id"), pa.array(same)], ["pass", "label", "dim", "key", "id", "same"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n))], [*batch.schema.names, "part", "row"])
            row += n

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "block"):
            bounds = run_bounds(rows.column("block").to_numpy())
            for s, e in zip(bounds, bounds[1:], strict=False):
                part = rows.slice(s, e - s)
                ids, group = part.column("id").to_numpy(), part.column("group").to_numpy()
                pairs = []
                cuts = run_bounds(group)  # a pass, label and length each
                for a, b in zip(cuts, cuts[1:], strict=False):
                    x = _matrix(part.column("embedding").slice(a, b - a))
                    for k in range(1, min(window, len(x) - 1) + 1):
                        near = np.flatnonzero(np.einsum("ij,ij->i", x[:-k], x[k:]) >= cosine) + a
                        pairs += zip(ids[near].tolist(), ids[near + k].tolist(), strict=True)
                links = spanning(pairs)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    order = ["pass", "label", "dim", "key", "id"]
    keyed = materialize(classes.join(centres, ["label", "dim"]).select("id", "label", "dim", "embedding", "centre").mapInArrow(keys, "pass int, label string, dim int, key long, id long, same double"), "projections")
    ranged = keyed.repartitionByRange(partitions(classes.sparkSession), *order).sortWithinPartitions(*order)
    placed = materialize(ranged.mapInArrow(number, keyed.schema.simpleString()[7:-1].replace(":", " ") + ", part int, row long"), "orders")
    total, bases = 0, []
    for r in sorted(placed.groupBy("part").agg(F.max("row").alias("last")).collect(), key=lambda r: r.part):
        bases.append((r.part, total))
        total += r.last + 1
    base = classes.sparkSession.createDataFrame(bases, "part int, base long")
    at = placed.join(base, "part").withColumn("at", F.col("base") + F.col("row")).withColumn("block", F.floor(F.col("at") / block))
    # the last vectors of a block also stand before the next one
    halo = at.where(F.col("at") % block >= block - window).withColumn("block", F.col("block") + 1)
    rows = at.union(halo).select("block", "at", F.xxhash64("pass", "label", "dim").alias("group"), "id")
    full = rows.join(classes.select("id", "embedding"), "id")
    dealt = full.repartitionByRange(partitions(classes.sparkSession), "block").sortWithinPartitions("block", "at")
    links = dealt.select("block", "group", "id", "embedding").mapInArrow(compare, "a long, b long").distinct()
    # the bits a vector shares with the ends of its window: a pass's order is cut by blocks again, with ends on both sides
    side = at.withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1))).where(
        (F.col("at") >= F.col("block") * block - window) & (F.col("at") < (F.col("block") + 1) * block + window)
    )
    side = side.select("block", "at", F.xxhash64("pass", "label", "dim").alias("group"), "id", "key", "same")

    def misses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "block"):
            where, at, group, key, same = (rows.column(c).to_numpy() for c in ("block", "at", "group", "key", "same"))
            bits = np.zeros(len(at), np.int64)  # a partner that agrees on so many is inside the window
            for shift in (window, -window):
                other = np.arange(len(at)) + shift
                ok = (other >= 0) & (other < len(at))
                other = np.where(ok, other, 0)
                ok &= (where[other] == where) & (group[other] == group)
                differ = np.frexp((key ^ key[other]).astype(np.float64))[1]  # place of the highest bit that differs
                bits = np.maximum(bits, np.where(ok, BITS - differ + 1, 0))
            met = np.where(bits > BITS, 0.0, same ** bits)
            own = at // block == where
            yield pa.RecordBatch.from_arrays([pa.array(rows.column("id").to_numpy()[own]), pa.array(np.log(np.maximum(1e-30, 1 - met[own])))], ["id", "lost"])

    ordered = side.repartitionByRange(partitions(classes.sparkSession), "block").sortWithinPartitions("block", "at")
    lost = ordered.mapInArrow(misses, "id long, lost double").groupBy("id").agg(F.sum("lost").alias("lost"))
    return links, lost


def all_links(classes: DataFrame, cosine: float) -> DataFrame:
    """(a, b): spanning links of every pair of a label and length, by blocks; rows (id, label, dim, embedding)."""
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("g"))
    placed = classes.join(sizes, ["label", "dim"]).withColumn("blocks", F.ceil(F.col("g") / F.least(F.greatest(F.col("g") / 64, F.lit(1024)), F.lit(8192))).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    each = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select(F.xxhash64("label", "dim", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "id", "embedding")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "task"):
            bounds = run_bounds(rows.column("task").to_numpy())
            for s, e in zip(bounds, bounds[1:], strict=False):
                part = rows.slice(s, e - s)
                x, ids = _matrix(part.column("embedding")), part.column("id").to_numpy()
                links = []
                for low in range(0, len(ids), 512):
                    i, j = np.nonzero(x[low : low + 512] @ x[low:].T >= cosine)
                    i, j = i[i < j] + low, j[i < j] + low
                    links = spanning([*links, *zip(ids[i].tolist(), ids[j].tolist(), strict=True)])
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    dealt = each.repartition(partitions(classes.sparkSession), "task").sortWithinPartitions("task")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def near_links(classes: DataFrame, cosine: float, passes: int, window: int, exact: int) -> DataFrame:
    """(a, b): links that join what belongs together."""
    open_ = classes.select("id", "label", "dim", "embedding").withColumn("lost", F.lit(0.0))
    found = []
    for seed in range(ROUNDS + 1):
        sizes = open_.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("g"))
        large = materialize(sizes.where(F.col("g") > (exact if seed < ROUNDS else 1 << 62)).select("label", "dim"), "large-labels")
        found.append(materialize(all_links(open_.join(large, ["label", "dim"], "left_anti"), cosine), "vector-links"))
        if large.isEmpty():
            break
        open_ = open_.join(large, ["label", "dim"])
        unit = F.transform("embedding", lambda v: v.cast("double") / F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, w: s + w.cast("double") * w.cast("double"))))
        means = open_.select("label", "dim", F.posexplode(unit).alias("k", "v")).groupBy("label", "dim", "k").agg(F.avg("v").alias("v"))
        centres = means.groupBy("label", "dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("centre"))
        links, lost = neighbour_links(open_, materialize(centres, "centres"), cosine, passes, window, seed)
        found.append(materialize(links, "vector-links"))
        open_ = open_.join(lost.withColumnRenamed("lost", "more"), "id").withColumn("lost", F.col("lost") + F.col("more")).drop("more")
        open_ = materialize(open_.where(F.col("lost") > float(np.log(MISS))), "open-vectors")
    return functools.reduce(DataFrame.union, found)


def spanning(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that join what earlier ones had left apart."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for a, b in pairs:
        p, q = find(a), find(b)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((a, b))
    return out


def link_counts(members: DataFrame, cosine: float) -> DataFrame:
    """(id, links): per class the rows of other classes of its component that reach ``cosine``; rows (component, id, n, embedding)."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("g"))
    size = F.least(F.greatest(F.col("g") / 64, F.lit(64)), F.lit(8192))
    placed = members.join(sizes, "component").withColumn("blocks", F.ceil(F.col("g") / size).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    each = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select(F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("task"), (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"), "id", "n", "embedding")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "task"):
            bounds = run_bounds(rows.column("task").to_numpy())
            for s, e in zip(bounds, bounds[1:], strict=False):
                part = rows.slice(s, e - s)
                x, ids, n = _matrix(part.column("embedding")), part.column("id").to_numpy(), part.column("n").to_numpy()
                left, right = np.asarray(part.column("left")), np.asarray(part.column("right"))
                both = bool((left & right).all())  # a block with itself
                a, b = np.flatnonzero(left), np.flatnonzero(right)
                got = np.zeros(len(ids), np.int64)
                for low in range(0, len(a), 1024):
                    rows_a = a[low : low + 1024]
                    near = x[rows_a] @ x[b].T >= cosine
                    if both:
                        near[np.arange(len(rows_a)), rows_a] = False
                    got[rows_a] += near @ n[b]
                    if not both:
                        got[b] += n[rows_a] @ near
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(got)], ["id", "links"])

    dealt = each.repartition(partitions(members.sparkSession), "task").sortWithinPartitions("task")
    return dealt.mapInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, cosine: float = 0.98, passes: int = 12, window: int = 32, exact: int = 16_384) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows, classes = classes_of(vectors.select("vec_id", "embedding", "label"))
    classes = materialize(classes, "vector-classes")
    links = near_links(classes, cosine, passes, window, exact)
    comps = materialize(connected_components(links), "vector-components")
    free_shuffles(spark)
    members = materialize(classes.join(comps, "id").select("component", "id", "n", "embedding"), "vector-members")
    counts = link_counts(members, cosine)
    known = classes.select("id", "label", "h1", "h2", "n").join(comps, "id", "left").join(counts, "id", "left")
    verdict = rows.join(known, ["label", "h1", "h2"]).select(
        F.col("vec_id").alias("_id"), F.col("label").alias("_label"), F.col("h1").alias("_h1"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "id").alias("component"),
    )
    # a vec_id with several vectors takes the smallest component any of them reaches
    verdict = verdict.groupBy("_id", "_label", "_h1").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.xxhash64("embedding").alias("h1"))
    out = own.join(verdict, (F.col("vec_id") == F.col("_id")) & (F.col("label") == F.col("_label")) & (F.col("h1") == F.col("_h1")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a
), c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id), n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT c.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n ON c.vec_id = n.a
"""
