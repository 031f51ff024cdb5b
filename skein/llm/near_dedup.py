"""MinHash near-dedup: chosen-path set similarity join.

A document's set is its distinct word shingles. Documents with equal sets are
one class from the start; only one representative of each goes on. Independent
trees branch the representatives by minwise tokens: at depth d of a tree a
document follows the branch of its smallest shingle under the tree's d-th hash
function, so two documents of Jaccard similarity s stay together with
probability s per step. A node of at most ``small`` documents is compared
exhaustively; a larger node branches again.

Comparing. All pairs of a node are first held against each other by one byte of
each minwise token; pairs whose agreement is six standard deviations below the
threshold (a chance under 1e-6) are out. What is left falls into groups, and only
their texts are fetched: every pair of a group that is still possible is decided
on full shingle sets. Equal groups found by several trees are decided once.

Large nodes of near copies. Every large node names a few pivots; each document is
held against the first pivots, in one fixed order, that it may be similar to.
With the components of these links a large node whose largest component leaves at
most ``small`` members outside is closed at its depth: the outsiders are compared
with every member, by blocks spread over tasks. Pairs inside one component are
not compared again, they add nothing to the result. What is still open at the
last depth is closed the same way, however many the outsiders.

Recall. A document's node closes (or it stands alone) at some depth in each tree.
Which depth that is depends on the same tokens that tell whether a partner stays
(among documents of one template, a branch becomes small just where it follows a
token of few), so the depths of one tree are not used for that tree's chance: with
d the greatest closing depth in any of a document's trees, a partner at the
threshold t is in each tree's closing node with probability t^d at least, and the
chance to miss it is (1 - t^d) to the number of trees. More trees are drawn for
the documents above ``MISS`` until none is left: 8 trees are enough at t = 0.85
(10 at 0.80) where all nodes close at depth 2, and none needs more than
ln(MISS) / ln(1 - t^12) = 67 (143). A pair is found through either end, so a
later round holds only the documents still open.

Scale. Shuffled are signatures (4 bytes per function), node keys, one byte per
function for documents in nodes of two or more, and, once for pivots and once
for groups, the texts; only texts of documents with a possible partner leave that
shuffle. Node sizes are partial aggregates. At most ``small`` members, or blocks
of as many, meet in one task. Links are spanning per task and become components
by joins (``components.py``), never on the driver.

Defined cases. No word or null text: empty set, n_shingles 0, links with
nothing. Fewer words than a shingle: the whole sequence is the one shingle.
Rows with null doc_id take no part: component null, kept. Rows that repeat a
doc_id are one document whose links are those of all its texts. Ties take the
smallest doc_id. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm._runs import run_bounds, runs
from skein.llm._store import discard, free_shuffles, materialize, partitions, text_key
from skein.llm._words import gram_weights, grams, mix64, slices, word_hashes
from skein.llm.components import connected_components
from skein.session import table

TREES, DEPTH = 8, 12
#: The depths at which a node's size is looked at, beside the last.
TOP, LEVELS = 2, (2, 3, 4, 5, 6, 8, 10)
#: Functions whose lowest byte tells possible pairs, and how many standard deviations below the threshold are possible.
BYTES, SIGMAS = 128, 6
#: Pivots a document is held against, and members beside one pivot in a task.
PIVOTS, BESIDE = 2, 256
#: A document's greatest chance to miss a partner at the threshold.
MISS = 4e-5


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = word_hashes(texts, fold=True)
    h, place = grams(words, n)
    cut = np.searchsorted(place, words.bounds)
    out = []
    for t in range(len(texts)):
        a, b = cut[t], cut[t + 1]
        if b > a:
            out.append(np.unique(h[a:b]))
            continue
        own = words.hashes[words.bounds[t] : words.bounds[t + 1]]
        if not len(own):
            out.append(own)
        else:  # shorter than a shingle: the sequence itself, apart from real shingles by its length
            out.append(mix64((own * gram_weights(n)[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own))))
    return out


@functools.cache
def _functions(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def signatures(sets: list[np.ndarray], count: int, seed: int = 85) -> np.ndarray:
    """(len(sets), count) minwise tokens; every set has a member."""
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    mult, add = _functions(count, seed)
    out = np.empty((len(sets), count), np.uint32)
    for k in range(count):
        out[:, k] = np.minimum.reduceat(x * mult[k] + add[k], starts)
    return out


def features(docs: DataFrame, n: int, trees: int, depth: int, seed: int = 85) -> DataFrame:
    """(doc_id, tk, n_shingles, s1, s2, sig, low): set size, 128 bits of the set, minwise tokens, a byte of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 21):
                sets = shingle_sets(part.column("text"), n)
                full = [s for s in sets if len(s)]
                made = signatures(full, trees * depth, seed) if full else np.zeros((0, 1), np.uint32)
                sigs, low = iter(made.view(np.int32)), iter(made[:, :BYTES].astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("tk"), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([int(s.sum(dtype=np.uint64)) - (1 << 63) for s in sets], pa.int64()),
                        pa.array([int(np.bitwise_xor.reduce(mix64(s + np.uint64(77)))) - (1 << 63) if len(s) else 0 for s in sets], pa.int64()),
                        pa.array([next(sigs).tolist() if len(s) else None for s in sets], pa.list_(pa.int32())),
                        pa.array([next(low).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "tk", "n_shingles", "s1", "s2", "sig", "low"],
                )

    return docs.mapInArrow(run, "doc_id long, tk long, n_shingles long, s1 long, s2 long, sig array<int>, low binary")


def _similar(inter: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int):
    return 100 * inter >= percent * (a + b - inter)


def node_links(sets: list[np.ndarray], percent: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links among the members of one group, every pair with an end in ``left`` (all, if None) decided on full sets."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    flat, who = np.concatenate(sets), np.repeat(np.arange(n), sizes)

    def partners(i: int) -> list[tuple[int, int]]:
        place = np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)
        close = _similar(np.bincount(who[sets[i][place] == flat], minlength=n), sizes[i], sizes, percent)
        close[i] = False
        return [(i, j) for j in np.flatnonzero(close).tolist()]

    star = left is not None and not left.all()
    if not star and n <= 8:
        pairs = [
            (i, j) for i in range(n) for j in range(i + 1, n)
            if 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j])
            and _similar(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), sizes[i], sizes[j], percent)
        ]
    elif star:
        pairs = (pair for i in np.flatnonzero(left).tolist() for pair in partners(i))
    elif n > 64 and (outside := _outside(n, partners)) is not None:
        pairs = outside
    else:
        _, column = np.unique(flat, return_inverse=True)
        shared = np.bincount(column)[column] > 1  # a shingle of one member adds to no intersection
        _, column = np.unique(column[shared], return_inverse=True)
        who, inter = who[shared], np.zeros((n, n), np.float32)
        order = np.argsort(column, kind="stable")
        column, who = column[order], who[order]
        span = max(1 << 10, (1 << 22) // n)
        for low in range(0, int(column.max(initial=-1)) + 1, span):
            a, b = np.searchsorted(column, (low, low + span))
            m = np.zeros((n, span), np.float32)
            m[who[a:b], column[a:b] - low] = 1
            inter += m @ m.T
        close = np.triu(_similar(inter, sizes[:, None], sizes[None, :], percent), 1)
        pairs = zip(*(x.tolist() for x in np.nonzero(close)), strict=True)
    out = []
    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _outside(n: int, partners) -> list[tuple[int, int]] | None:
    """Links of a group most of which some first members hold together: those members' links and those of all others' outside
    the largest component; None if that is no shorter than comparing all pairs."""
    label, pairs, seen = np.arange(n), [], set()
    for _ in range(8):
        i = int(np.flatnonzero(label == np.bincount(label).argmax())[0]) if not seen else next((k for k in range(n) if k not in seen and label[k] != major), -1)
        if i < 0:
            break
        seen.add(i)
        for a, b in partners(i):
            pairs.append((a, b))
            if label[a] != label[b]:
                label[label == max(label[a], label[b])] = min(label[a], label[b])
        major = np.bincount(label).argmax()
    rest = [k for k in np.flatnonzero(label != major).tolist() if k not in seen]
    if len(rest) > n // 8:
        return None
    return pairs + [pair for k in rest for pair in partners(k)]


def least_agreement(percent: int, functions: int) -> float:
    """Tokens on which a pair at the threshold agrees, but for a chance under 1e-6."""
    t = percent / 100
    return functions * t - SIGMAS * math.sqrt(functions * t * (1 - t))


def possible_groups(low: np.ndarray, sizes: np.ndarray, comps: np.ndarray, left: np.ndarray, percent: int) -> np.ndarray:
    """For each member of a task the least member of its group: what a chain of possible pairs with an end in ``left`` joins."""
    n = len(low)
    least = least_agreement(percent, low.shape[1])
    rows = np.flatnonzero(left)
    label = np.arange(n)
    near = np.zeros((len(rows), n), bool)
    step = max(1, (1 << 23) // (n * low.shape[1]))
    for at in range(0, len(rows), step):
        own = rows[at : at + step]
        # no pair with sizes too far apart, and none inside a component
        maybe = (100 * np.minimum(sizes[own, None], sizes) >= percent * np.maximum(sizes[own, None], sizes)) & (comps[own, None] != comps)
        i, j = np.nonzero(maybe)
        for part in range(0, len(i), 1 << 16):
            a, b = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
            maybe[a, b] = (low[own[a]] == low[b]).sum(1, dtype=np.uint16) >= least
        near[at : at + step] = maybe
    if not near.any():
        return label
    while True:
        mine = np.where(near, label, n).min(1)
        mine = np.minimum(mine, label[rows])
        now = np.minimum(label, np.where(near, mine[:, None], n).min(0))
        now[rows] = np.minimum(now[rows], mine)
        if (now == label).all():
            return label
        label = now


def possible(tasks: DataFrame, reps: DataFrame, comps: DataFrame | None, percent: int) -> DataFrame:
    """(group, id, lead) from rows (task, id, lead) of tasks that fit one: members that may have a partner, each group once."""
    known = reps.select("id", "doc_id", "n_shingles", "low")
    if comps is None:
        rows = tasks.join(known.withColumn("c", F.col("id")), "id")
    else:
        named = known.join(comps.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
        # without a component of its own a class is apart from all others, also from one that shares its doc_id
        rows = tasks.join(named.withColumn("c", F.coalesce("component", "id")), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "task"):
            bounds = run_bounds(rows.column("task").to_numpy())
            ids, sizes, comp, left = (np.asarray(rows.column(c)) for c in ("id", "n_shingles", "c", "lead"))
            low = rows.column("low").combine_chunks()
            low = np.frombuffer(b"".join(low.to_pylist()), np.uint8).reshape(len(ids), -1)
            out = []
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b - a < 2:
                    continue
                label = possible_groups(low[a:b], sizes[a:b], comp[a:b], left[a:b], percent)
                count = np.bincount(label, minlength=b - a)
                member = np.flatnonzero(count[label] > 1)
                if not len(member):
                    continue
                own, lead = ids[a:b][member], left[a:b][member]
                name = np.zeros(b - a, np.uint64)  # a group is named by its members
                np.add.at(name, label[member], mix64(own.view(np.uint64) * np.uint64(2) + lead))
                out.append((mix64(name + count.astype(np.uint64))[label[member]].view(np.int64), own, lead))
            if out:
                group, own, lead = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(own), pa.array(lead)], ["group", "id", "lead"])

    dealt = rows.select("task", "id", "lead", "n_shingles", "low", "c").repartition(partitions(tasks.sparkSession), "task").sortWithinPartitions("task")
    return dealt.mapInArrow(run, "group long, id long, lead boolean")


def verified(groups: DataFrame, keyed: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): spanning links of doc_ids from rows (group, id, lead), decided on the full sets of whole texts."""
    wanted = groups.groupBy("id").agg(F.collect_set(F.struct("group", "lead")).alias("groups"))
    texts = keyed.where("doc_id IS NOT NULL").select(F.xxhash64("doc_id", "tk").alias("id"), F.col("doc_id").alias("own"), "text")
    texts = texts.join(wanted, "id").dropDuplicates(["id"])
    members = texts.select("own", "text", F.explode("groups").alias("at")).select(F.col("at.group").alias("group"), F.col("at.lead").alias("lead"), "own", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "group"):
            bounds = run_bounds(rows.column("group").to_numpy())
            for a, b in zip(bounds, bounds[1:], strict=False):
                part = rows.slice(a, b - a)
                ids, left = part.column("own").to_pylist(), np.asarray(part.column("lead"))
                links = node_links(shingle_sets(part.column("text").combine_chunks(), n), percent, left)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in links], pa.int64()), pa.array([ids[j] for _, j in links], pa.int64())], ["a", "b"])

    dealt = members.repartition(partitions(members.sparkSession), "group").sortWithinPartitions("group")
    return dealt.mapInArrow(run, "a long, b long")


def pivot_groups(large: DataFrame, pivots: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(group, id, lead): each member of a large node (id, node) beside the first pivots (node, pid) it may be similar to."""
    least = least_agreement
    faces = pivots.join(reps.select(F.col("id").alias("pid"), F.col("low").alias("plow")), "pid")
    rows = large.join(faces, "node").where("id <> pid").select("id", "pid", "plow").join(reps.select("id", "low"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("low", "plow"))
            keep = pa.array((x == y).sum(1) >= least(percent, x.shape[1]))
            yield batch.select(["id", "pid"]).filter(keep)

    near = rows.select("id", "pid", "low", "plow").mapInArrow(run, "id long, pid long")
    first = near.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("pid").alias("h"), "pid"))), 1, PIVOTS).alias("ps"))
    pairs = materialize(first.select("id", F.explode("ps.pid").alias("pid")), "pivot-pairs")
    sizes = pairs.groupBy("pid").agg(F.ceil(F.count(F.lit(1)) / BESIDE).cast("int").alias("blocks"))
    beside = pairs.join(sizes, "pid").select(F.xxhash64(F.lit("pivot"), "pid", F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("group"), "id", "pid")
    heads = beside.select("group", F.col("pid").alias("id"), F.lit(True).alias("lead")).distinct()
    return beside.select("group", "id", F.lit(False).alias("lead")).union(heads)


def node_parts(large: DataFrame, reps: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, id, c) of members of large nodes with their components, and (node, major, size, outside)."""
    named = reps.select("id", "doc_id").join(comps.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    at = large.select("node", "id").join(named.select("id", F.coalesce("component", "id").alias("c")), "id")
    counts = at.groupBy("node", "c").agg(F.count(F.lit(1)).alias("k"))
    major = counts.groupBy("node").agg(F.max(F.struct("k", "c")).alias("m"), F.sum("k").alias("size"))
    return at, materialize(major.select("node", F.col("m.c").alias("major"), "size", (F.col("size") - F.col("m.k")).alias("outside")), "major-components")


def outsider_tasks(at: DataFrame, major: DataFrame, small: int) -> DataFrame:
    """(task, id, lead): blocks of the members outside a node's largest component beside blocks of all its members."""
    lefts, rights = F.ceil(F.col("outside") / (small // 2 + 1)).cast("int"), F.ceil(F.col("size") / small).cast("int")
    rows = at.join(major.where("outside > 0"), "node").select(
        "node", "id", (F.col("c") != F.col("major")).alias("out"), lefts.alias("lefts"), rights.alias("rights"), F.xxhash64("id").alias("h")
    )

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    task = F.xxhash64(F.lit("outside"), "node", "i", "j").alias("task")
    inner = rows.withColumn("j", F.pmod("h", F.col("rights"))).withColumn("i", every("lefts")).select(task, "id", F.lit(False).alias("lead"))
    outer = rows.where("out").withColumn("i", F.pmod("h", F.col("lefts"))).withColumn("j", every("rights")).select(task, "id", F.lit(True).alias("lead"))
    return inner.union(outer).groupBy("task", "id").agg(F.max("lead").alias("lead"))


def _log_miss(percent: int, depth: int) -> float:
    """Logarithm of the chance that a pair at the threshold comes apart before ``depth``."""
    return math.log(max(1e-9, 1 - (percent / 100) ** depth))


def tree_levels(reps: DataFrame, trees: int, depth: int, small: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(id, tree, d, node) of small nodes of two or more members; the same of large nodes, and their pivots (node, pid); None if there is none."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.slice("sig", t * depth + 1, depth))
    level = reps.select("id", F.posexplode(cut).alias("tree", "path"))
    tiny, large, pivots = [], [], []
    for d in [*(x for x in LEVELS if x < depth), depth]:
        keyed = level.withColumn("node", F.xxhash64("tree", F.slice("path", 1, d)))
        draws = [F.min(F.struct(F.xxhash64(F.lit(k), "id").alias("h"), "id")).alias(f"p{k}") for k in range(PIVOTS)]
        sizes = materialize(keyed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *draws).where("n > 1"), "nodes")
        tiny.append(keyed.join(sizes.where(F.col("n") <= small).select("node"), "node").select("id", "tree", F.lit(d).alias("d"), "node"))
        big = sizes.where(F.col("n") > small)
        if big.isEmpty():
            break
        level = materialize(keyed.join(big.select("node"), "node").select("id", "tree", "path", "node"), "large-nodes")
        large.append(level.select("id", "tree", F.lit(d).alias("d"), "node"))
        pivots.append(big.select("node", F.explode(F.array(*(f"p{k}.id" for k in range(PIVOTS)))).alias("pid")).distinct())
        level = level.drop("node")
    union = functools.partial(functools.reduce, DataFrame.union)
    return union(tiny), union(large) if large else None, union(pivots) if pivots else None


def round_components(keyed: DataFrame, reps: DataFrame, known: DataFrame, comps: DataFrame | None, trees: int, depth: int, small: int, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Components (id, component) of the links ``known`` (a, b) and those of ``trees`` trees over ``reps``; (id, w): what depths
    below ``TOP`` add to a document's log chance to miss a partner."""
    spark = keyed.sparkSession
    tiny, large, pivots = tree_levels(reps, trees, depth, small)
    excess = spark.createDataFrame([], "id long, w double")
    closing = tiny.select("id", "tree", "d", "node")
    outside = None
    if large is not None:
        groups = materialize(pivot_groups(large, materialize(pivots, "pivots"), reps, percent), "pivot-groups")
        comps = materialize(connected_components(materialize(verified(groups, keyed, n, percent), "pivot-links").union(known)), "components")
        known = _as_links(comps)
        free_shuffles(spark)
        at, major = node_parts(large, reps, comps)
        deepest = large.agg(F.max("d")).first()[0]
        shut = major.where(F.col("outside") <= small).select("node")
        if deepest >= depth:
            shut = shut.union(large.where(F.col("d") >= depth).select("node")).distinct()
        ends = closing.withColumn("big", F.lit(False)).union(large.join(shut, "node").select("id", "tree", "d", "node", F.lit(True)))
        ends = ends.groupBy("id", "tree").agg(F.min(F.struct("d", "node", "big")).alias("e"))
        closing = materialize(ends.select("id", "tree", "e.*"), "closing-nodes")
        free_shuffles(spark)
        last = large.groupBy("id", "tree").agg(F.max("d").alias("m")).join(closing, ["id", "tree"], "left")
        steps = F.create_map(*(F.lit(x) for d in range(depth + 2) for x in (d, _log_miss(percent, d) - _log_miss(percent, min(TOP, depth)))))
        # alone behind its last large node: together with a partner up to the next depth looked at
        after = F.create_map(*(F.lit(x) for a, b in zip((*LEVELS, depth), (*LEVELS[1:], depth, depth), strict=False) for x in (a, min(b, depth))))
        at_depth = F.coalesce(F.col("d"), F.least(after[F.col("m")], F.lit(depth)))
        excess = last.groupBy("id").agg((trees * steps[F.max(at_depth)]).alias("w"))
        used = closing.where("big").select("node").distinct()
        outside = outsider_tasks(at, materialize(major.join(used, "node"), "closed-nodes"), small)
        closing = closing.where("NOT big")
    tasks = closing.select(F.col("node").alias("task"), "id", F.lit(True).alias("lead"))
    if outside is not None:
        tasks = tasks.union(outside)
    groups = materialize(possible(tasks, reps, comps, percent).distinct(), "groups")
    free_shuffles(spark)
    comps = materialize(connected_components(verified(groups, keyed, n, percent).union(known)), "components")
    free_shuffles(spark)
    return comps, excess


def _as_links(comps: DataFrame) -> DataFrame:
    return comps.select(F.col("id").alias("a"), F.col("component").alias("b"))


def near_duplicates(docs: DataFrame, percent: int = 85, n: int = 5, trees: int = TREES, depth: int = DEPTH, small: int = 4096) -> DataFrame:
    """(doc_id, tk, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text); ``trees`` is the least number of trees."""
    spark = docs.sparkSession
    top = _log_miss(percent, min(TOP, depth))
    trees = max(trees, math.ceil(math.log(MISS) / top))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tk"), "text")
    feats = materialize(features(keyed, n, trees, depth), "signatures")
    sets = feats.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = sets.groupBy("n_shingles", "s1", "s2").agg(F.min(F.struct("doc_id", "tk")).alias("rep"))
    classes = materialize(classes.select("n_shingles", "s1", "s2", F.col("rep.doc_id").alias("rep"), F.col("rep.tk").alias("rep_tk")), "classes")
    free_shuffles(spark)
    own = classes.select(F.col("rep").alias("doc_id"), F.col("rep_tk").alias("tk"), "n_shingles", "s1", "s2")
    reps = sets.join(own, ["doc_id", "tk", "n_shingles", "s1", "s2"]).dropDuplicates(["doc_id", "tk"])
    # a class is named by 64 bits over its representative, so a doc_id with several texts has several
    named = [F.xxhash64("doc_id", "tk").alias("id"), "doc_id", "tk", "n_shingles", "sig", "low"]
    reps = materialize(reps.select(*named), "reps")
    copies = sets.join(classes, ["n_shingles", "s1", "s2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comps, excess = round_components(keyed, reps, copies, None, trees, depth, small, n, percent)
    lost, seed = reps.select("id", "doc_id", "tk", F.lit(0.0).alias("lost")), 85
    while True:
        lost = lost.join(excess.groupBy("id").agg(F.sum("w").alias("w")), "id", "left")
        lost = lost.withColumn("lost", F.col("lost") + trees * top + F.coalesce("w", F.lit(0.0))).drop("w")
        lost = materialize(lost.where(F.col("lost") > math.log(MISS)), "open-documents")
        most = lost.agg(F.max("lost")).first()[0]
        if most is None:
            break
        trees, seed = min(4 * trees, math.ceil((most - math.log(MISS)) / -_log_miss(percent, depth))), seed + 1
        more = keyed.join(lost.select("doc_id", "tk"), ["doc_id", "tk"]).dropDuplicates(["doc_id", "tk"]).select("doc_id", "tk", "text")
        reps = materialize(features(more, n, trees, depth, seed).select(*named), "reps")
        comps, excess = round_components(keyed, reps, _as_links(comps), comps, trees, depth, small, n, percent)
        discard(reps)
    out = feats.select("doc_id", "tk", "n_shingles").join(comps.select(F.col("id").alias("_id"), "component"), F.col("doc_id") == F.col("_id"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "tk", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END) AS sh FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM s UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a
), c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
