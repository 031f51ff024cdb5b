"""Chat formatting [native]: cumulative-snapshot collapse.

Chat logs often hold a conversation again after every turn, so most logged
conversations are prefixes of longer ones. Each turn gets 128 bits of hash over
(position, role, text); the xor of a conversation's first n of them is its
rolling prefix hash. A conversation whose full hash is a proper prefix hash of
another is anti-joined away; of equal conversations the smallest conv_id stays.
The survivors are rendered.

Scale. Positions and prefix hashes are running windows in two levels (turns in
chunks of ``CHUNK``, then chunk totals), so not even one conversation that
holds a third of all rows meets in one sort of its turns. Prefixes are reduced
per hash by a partial aggregate before any join; the anti-joins are plain sort
merge joins, whose hot side adaptive execution may split. Rendering gathers a
kept conversation's turns, which form one output row anyway.

Defined cases. Turns are ordered by (turn, role, text), nulls first; rows that
repeat a turn are turns of their own. Null role or text takes part as null and
renders as an empty string. Rows with null conv_id belong to no conversation
and are ignored. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm._store import materialize
from skein.session import table

CHUNK = 4096
#: The chunk of null turns, before every other.
NULLS = -(1 << 62)


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, n, p1, p2): hashes of every prefix of n turns."""
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", "role", "text", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(NULLS)).alias("chunk")
    )
    within = Window.partitionBy("conv_id", "chunk").orderBy(
        F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")
    )
    sizes = rows.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("m"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("before", F.coalesce(F.sum("m").over(earlier), F.lit(0)))
    at = rows.withColumn("i", F.row_number().over(within)).join(
        starts.select("conv_id", "chunk", "before"), ["conv_id", "chunk"]
    )
    # a null and an empty string hash apart
    parts = ["n", F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    hashed = at.withColumn("n", F.col("before") + F.col("i")).select(
        "conv_id", "chunk", "n", F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *parts).alias("h2")
    )
    hashed = materialize(hashed, "turn-hashes")
    totals = hashed.groupBy("conv_id", "chunk").agg(F.bit_xor("h1").alias("c1"), F.bit_xor("h2").alias("c2"))
    base = totals.select(
        "conv_id", "chunk", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(b) for c, b in (("c1", "b1"), ("c2", "b2"))]
    )
    running = Window.partitionBy("conv_id", "chunk").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    local = hashed.select("conv_id", "chunk", "n", F.bit_xor("h1").over(running).alias("r1"), F.bit_xor("h2").over(running).alias("r2"))
    return local.join(base, ["conv_id", "chunk"]).select(
        "conv_id", "n", F.col("r1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("r2").bitwiseXOR(F.col("b2")).alias("p2")
    )


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of conversations that no other one extends, one of each set of equals."""
    prefixes = materialize(prefix_hashes(turns), "prefixes")
    length = prefixes.groupBy("conv_id").agg(F.max("n").alias("n_turns"))
    marked = prefixes.join(length, "conv_id").withColumn("full", F.col("n") == F.col("n_turns"))
    marked = materialize(marked, "prefix-ends")
    full = marked.where("full").select("conv_id", "n", "p1", "p2")
    extended = marked.where("NOT full").select("n", "p1", "p2").distinct()
    first = full.groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    return first.join(extended, ["n", "p1", "p2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered): ``<|role|>`` and text per turn, in order, a line feed after each."""
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    rows = turns.select("conv_id", "turn", "role", "text").join(kept, "conv_id").select("conv_id", "n_turns", F.struct("turn", "role", "text", line.alias("line")).alias("t"))
    gathered = rows.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return gathered.select("conv_id", "n_turns", F.array_join(F.col("ts.line"), "").alias("rendered"))


def op4_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return render(turns, maximal(turns))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l,
         CAST(count(*) AS BIGINT) AS n_turns,
         string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), ''
                    ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), proper AS (
  SELECT DISTINCT l[1:k] AS p FROM t, range(1, 10000) r(k) WHERE k < n_turns
), firsts AS (SELECT l, min(conv_id) AS conv_id FROM t GROUP BY l)
SELECT t.conv_id, t.n_turns, t.rendered FROM t JOIN firsts USING (conv_id)
WHERE NOT EXISTS (SELECT 1 FROM proper WHERE proper.p = t.l)
"""
