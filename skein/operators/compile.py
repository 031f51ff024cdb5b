"""Context compiler: weighted retrieval, graph expansion, token budget, delivery ledger."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import graph
from skein.storage import cut

SEEDS, DAMPING, FLOOR, DECAY, PRIMARY_SHARE, DEFAULT_BUDGET = 7, 0.4, 0.3, 0.6, 0.6, 2500
#: Fixed value: how cl100k_base splits text before merging.
CL100K_PATTERN = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s"""
LEVELS = ("name", "signature", "skeleton", "body")


def terms_of(tasks: DataFrame) -> DataFrame:
    """(task, term, times) from (task, prompt): each distinct term and how often the list holds it."""
    return tasks.select("task", F.explode(T.task_terms(F.col("prompt"))).alias("term")).groupBy("task", "term").agg(F.count(F.lit(1)).alias("times"))


def index_of(entities: DataFrame) -> DataFrame:
    """(entity_id, side, token, part): an inverted index of names and symbol paths; ``part`` marks camel parts, the only tokens that stems match.

    Side ``whole`` holds the lower-case name itself.
    """
    path = T.symbol_path(F.col("qualified"))

    def side(name: str, text: Column) -> list[Column]:
        whole = F.transform(T.words(text), lambda w: F.struct(F.lit(name).alias("side"), F.lower(w).alias("token"), F.lit(False).alias("part")))
        parts = F.transform(T.camel_parts(text), lambda p: F.struct(F.lit(name).alias("side"), p.alias("token"), F.lit(True).alias("part")))
        return [whole, parts]

    name = F.array(F.struct(F.lit("whole").alias("side"), F.lower("name").alias("token"), F.lit(False).alias("part")))
    every = F.array_distinct(F.concat(name, *side("name", F.col("name")), *side("path", path)))
    return entities.select("entity_id", F.explode(every).alias("x")).select("entity_id", "x.*")


def matches(terms: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, term, whole, name_tier, path_tier) of entities that a term matches at all.

    Terms, a few words of queries, meet the index's distinct tokens only; what
    matches is written, so that its size is known, and joined to the index by token.
    """
    index, asked = index_of(entities), cut(terms.select("term").distinct(), "terms")
    words = index.where("side <> 'whole'").select("token", "part").distinct().crossJoin(asked)
    term, token = F.col("term"), F.col("token")
    tier = F.when(term == token, 1.0).when(F.col("part") & T.stem_match(term, token), 0.6)
    near = cut(words.withColumn("tier", tier).where("tier > 0"), "tokens")
    names = entities.select("entity_id", F.lit("whole").alias("side"), F.lower("name").alias("term"))
    wholes = names.join(asked, "term").select("entity_id", "side", "term", F.lit(1.0).alias("tier"))
    found = index.where("side <> 'whole'").join(near, ["token", "part"]).select("entity_id", "side", "term", "tier").union(wholes)

    def best(side: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("side") == side, F.col("tier"))), F.lit(0.0))

    return found.groupBy("entity_id", "term").agg(best("whole").alias("whole"), best("name").alias("name_tier"), best("path").alias("path_tier"))


def document_frequency(terms: DataFrame, entities: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(task, term, df): entities whose name or symbol path matches the term, once per time the term stands in the list; ``found``: their ``matches``, if known."""
    hits = (matches(terms, entities) if found is None else found).where("name_tier > 0 OR path_tier > 0").groupBy("term").agg(F.count(F.lit(1)).alias("k"))
    return terms.join(hits, "term", "left").select("task", "term", F.coalesce(F.col("k") * F.col("times"), F.lit(0)).alias("df"))


def term_weights(terms: DataFrame, entities: DataFrame, damping: float = DAMPING, once: bool = False, found: DataFrame | None = None) -> DataFrame:
    """(task, term, weight): 1 + damping * ln((N + 1) / (df + 1)). ``once`` counts a repeated term once."""
    counted = terms.withColumn("times", F.lit(1).cast("long")) if once else terms
    n = entities.agg(F.count(F.lit(1)).alias("total"))
    weight = 1 + damping * F.log((F.col("total") + 1) / (F.col("df") + 1))
    return document_frequency(counted, entities, found).crossJoin(n).select("task", "term", weight.alias("weight"))


def scores(terms: DataFrame, weights: DataFrame, entities: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(task, entity_id, score > 0): whole names count ten, name words three, path words one weight each."""
    weighted = terms.select("task", "term").join(weights, ["task", "term"], "left").withColumn("w", F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0))
    w = F.col("w")
    point = F.when(F.col("whole") > 0, 10 * w).when(F.col("name_tier") > 0, 3 * w * F.col("name_tier")).otherwise(w * F.col("path_tier"))
    hits = (matches(terms, entities) if found is None else found).join(weighted, "term").select("task", "entity_id", point.alias("p")).where("p > 0")
    return hits.groupBy("task", "entity_id").agg(F.sum("p").alias("score"))


def top_per(df: DataFrame, key: str, order: list[Column], k: int, buckets: int = 64) -> DataFrame:
    """The first ``k`` rows of each key, with ``rank`` from 1; each bucket of a key first keeps its own first ``k``, so a key is never sorted in one task."""
    bucket = F.pmod(F.xxhash64("entity_id"), F.lit(buckets))
    local = df.withColumn("rank", F.row_number().over(Window.partitionBy(key, bucket).orderBy(*order))).where(F.col("rank") <= k)
    return local.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def seeds(scored: DataFrame, entities: DataFrame, file_part: str = "", k: int = SEEDS) -> DataFrame:
    """(task, entity_id, score, rank) of the best entities that are no tests."""
    allowed = entities.where(F.col("kind") != "Test")
    if file_part:
        allowed = allowed.where(F.col("file").contains(file_part))
    found = scored.where("score > 0").join(allowed.select("entity_id").distinct(), "entity_id", "left_semi")
    return top_per(found, "task", [F.desc("score"), F.asc("entity_id")], k)


def expand(seeded: DataFrame, entities: DataFrame, edges: DataFrame, depth: int = 2, decay: float = DECAY, floor: float = FLOOR) -> DataFrame:
    """(task, entity_id, score, category, rank): seeds, and their neighbours at decayed scores.

    A neighbour below ``floor`` times the task's best seed is dropped; of several
    seeds that reach one entity the best-ranked accepted one counts.
    """
    seeded = cut(seeded, "seeds")  # a few rows, read four times below
    best = seeded.groupBy("task").agg(F.max("score").alias("best"))
    near = graph.related(entities, edges, seeded.select("entity_id").distinct(), depth)
    reached = seeded.withColumnRenamed("entity_id", "start_id").withColumnRenamed("rank", "seed_rank").join(near.select("start_id", "entity_id", "depth"), "start_id")
    reached = reached.withColumn("score", F.col("score") * F.pow(F.lit(decay), F.col("depth")))
    accepted = reached.join(best, "task").where(F.col("score") >= floor * F.col("best")).join(seeded.select("task", "entity_id"), ["task", "entity_id"], "left_anti")
    first = accepted.groupBy("task", "entity_id").agg(F.min(F.struct("seed_rank", "score")).alias("f")).select("task", "entity_id", F.col("f.score").alias("score"), F.lit("related").alias("category"))
    both = seeded.select("task", "entity_id", "score", F.lit("primary").alias("category")).union(first)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("task").orderBy(F.desc("score"), "entity_id")))


def with_levels(candidates: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """``level`` by category, or ``name`` for what was already delivered as fully; ``ledger`` has (task, entity_id, level int)."""
    wanted = F.when(F.col("category") == "primary", "skeleton").otherwise("signature")
    number = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), wanted) - 1
    if ledger is None:
        return candidates.withColumn("level", wanted).withColumn("already_sent", F.lit(False))
    prior = ledger.select("task", "entity_id", F.col("level").alias("prior"))
    sent = F.coalesce(F.col("prior") >= number, F.lit(False))
    joined = candidates.join(prior, ["task", "entity_id"], "left")
    return joined.withColumn("level", F.when(sent, "name").otherwise(wanted)).withColumn("already_sent", sent).drop("prior")


def rendered(candidates: DataFrame, entities: DataFrame, files: DataFrame) -> DataFrame:
    """``text`` of each candidate from the sources; what can't be read keeps its qualified name."""
    e = entities.select("entity_id", "qualified", "file", "start_line", "end_line").dropDuplicates(["entity_id"])
    f = files.select(F.col("path").alias("file"), F.col("text").alias("source"))
    head = T.trim_space(T.first_line(F.col("source"), F.col("start_line")))
    body = T.lines_of(F.col("source"), F.col("start_line"), F.col("end_line"))
    short = F.concat("qualified", F.lit("  "), F.coalesce(head, F.lit("")))
    text = (
        F.when(F.col("level") == "name", F.col("qualified"))
        .when(F.col("level") == "body", F.coalesce(body, "qualified"))
        .when((F.col("level") == "signature") & F.col("source").isNull(), F.col("qualified"))
        .otherwise(short)
    )
    return candidates.join(e, "entity_id").join(f, "file", "left").withColumn("text", text).drop("source")


def byte_quarters(text: Column) -> Column:
    """Token count without a tokenizer's ranks: a quarter of the bytes."""
    return F.floor(F.octet_length(text) / 4).cast("int")


def tiktoken_counter(rank_file: str, pattern: str) -> Callable[[Column], Column]:
    """Token counts by a byte-pair encoding whose ranks are in a file of (base64, rank) lines."""

    @F.pandas_udf("int")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in texts:
            yield batch.fillna("").map(lambda t: len(encoding.encode_ordinary(t)))

    return count


def counter(rank_file: str = "", pattern: str = CL100K_PATTERN) -> Callable[[Column], Column]:
    """The counter that a rank file gives, or the estimate without one."""
    return tiktoken_counter(rank_file, pattern) if rank_file else byte_quarters


def knapsack(costs: list[int], values: list[float], capacity: int) -> list[int]:
    """Places of the chosen items, last first: most value within ``capacity``, an item only where it strictly gains; none if all costs are 0."""
    capacity = min(capacity, sum(costs))
    if capacity <= 0:
        return []
    best = [[0.0] * (capacity + 1)]
    for cost, value in zip(costs, values, strict=True):
        row = best[-1].copy()
        for c in range(cost, capacity + 1):
            with_it = best[-1][c - cost] + value
            if with_it > row[c]:
                row[c] = with_it
        best.append(row)
    chosen, left = [], capacity
    for i in range(len(costs), 0, -1):
        if best[i][left] != best[i - 1][left]:
            chosen.append(i - 1)
            left -= costs[i - 1]
    return chosen


def budgeted(candidates: DataFrame, total: int = DEFAULT_BUDGET, share: float = PRIMARY_SHARE) -> DataFrame:
    """The chosen rows of (task, rank, entity_id, category, score, tokens), with ``place`` in delivery order.

    Primaries get ``int(share * total)`` tokens, the rest goes to related
    entities. A task's candidates are a few seeds and their close neighbours, so
    each task is one small list; many tasks go through Python together.
    """
    small = candidates.select("task", "entity_id", "category", "rank", "score", "tokens")
    kind = dict(candidates.dtypes)["task"]
    item = F.struct("rank", "entity_id", F.col("score").cast("double").alias("score"), F.col("tokens").cast("bigint").alias("tokens"))

    def own(category: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("category") == category, item))).alias(category)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ids, places = [], [], []
            for row, (primary, related) in enumerate(zip(batch["primary"].to_pylist(), batch["related"].to_pylist(), strict=True)):
                spent, place = 0, 0
                for items, room in ((primary, int(share * total)), (related, None)):
                    room = total - spent if room is None else room
                    costs = [x["tokens"] for x in items]
                    for i in knapsack(costs, [x["score"] for x in items], room) if total > 0 else ():
                        spent, place = spent + costs[i], place + 1
                        at.append(row)
                        ids.append(items[i]["entity_id"])
                        places.append(place)
            yield pa.RecordBatch.from_arrays([batch["task"].take(pa.array(at, pa.int64())), pa.array(ids, pa.string()), pa.array(places, pa.int32())], ["task", "entity_id", "place"])

    grouped = small.groupBy("task").agg(own("primary"), own("related"))
    picked = grouped.mapInArrow(choose, f"task {kind}, entity_id string, place int")
    return candidates.join(picked, ["task", "entity_id"])


def usage(candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per task: tokens used, items chosen, candidates considered."""
    seen = candidates.groupBy("task").agg(F.count(F.lit(1)).alias("considered"))
    used = chosen.groupBy("task").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("chosen"))
    return seen.join(used, "task", "left").fillna(0)


def assign_handles(delivered: DataFrame, ledger: DataFrame) -> DataFrame:
    """(session_id, entity_id, handle_no): known handles stay, new ones follow the session's largest in ``place`` order."""
    known = ledger.select("session_id", "entity_id", "handle_no")
    top = ledger.groupBy("session_id").agg(F.max("handle_no").alias("top"))
    first = delivered.groupBy("session_id", "entity_id").agg(F.min("place").alias("place"))
    new = first.join(known, ["session_id", "entity_id"], "left_anti").join(top, "session_id", "left")
    number = F.coalesce("top", F.lit(0)) + F.row_number().over(Window.partitionBy("session_id").orderBy("place", "entity_id"))
    return known.union(new.select("session_id", "entity_id", number.cast("int").alias("handle_no")))


def upgrade_ledger(ledger: DataFrame, delivered: DataFrame) -> DataFrame:
    """The ledger after a delivery (session_id, entity_id, level, place): handles stay, levels only rise."""
    handles = assign_handles(delivered, ledger)
    levels = ledger.select("session_id", "entity_id", "level").union(delivered.select("session_id", "entity_id", "level"))
    return handles.join(levels.groupBy("session_id", "entity_id").agg(F.max("level").alias("level")), ["session_id", "entity_id"])
