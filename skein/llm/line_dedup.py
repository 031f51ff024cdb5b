"""Line dedup [native]: range-partitioned line hashes, streamed first occurrences, keep bitmaps.

Every line of at least ``min_chars`` code points (after stripping and A-Z
lower-casing) is reduced to 128 bits of hash. The hashes are range-partitioned
with a secondary sort by document and position, and one pass over each sorted
range carries the first document of the current hash; a line of a later
document is a repeat. Only (document, position) leaves that pass; it is packed
into 64-bit words, and what comes back per document is a compressed keep bitmap,
the words that are not all ones, and never text.

Scale. The hash table is written once to the shared folder (lineage cut) and
feeds both the range sampling and the heavy-hash count. A hash that holds more
than 1/``HEAVY_PARTS`` of all lines is heavy; there can be at most
``HEAVY_PARTS`` of them, so their first documents, taken from the same partial
aggregate that finds them, are safe to broadcast, and their rows are salted
over ranges. Everything else has a group size bounded by that share.

Defined cases. Null or empty text: one empty line, kept. ``min_chars`` is in
code points of the key. Rows with null doc_id take no part (nothing of theirs
is dropped, they make nobody else drop). Rows that repeat a doc_id: a line
stays wherever the smallest doc_id holds it; identical rows get identical
results. Extra columns are ignored by the bitmap and, whatever their names, untouched
by ``apply``, but for its own three, which replace earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm._store import materialize, partitions, text_key
from skein.session import table

STRIP = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEAVY_PARTS = 256
SALTS = 64


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII takes the fast built-in."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, tk, pos, h1, h2) of every line whose key is long enough."""
    lines = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key().alias("tk"),
        F.posexplode(split_lines(F.col("text"))).alias("pos", "line"),
    )
    stripped = lines.withColumn("line", F.trim(F.col("line"), F.lit(STRIP))).where(F.char_length("line") >= min_chars)
    keyed = stripped.withColumn("line", ascii_lower(F.col("line")))
    return keyed.select("doc_id", "tk", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Per document that loses a line: (doc_id, tk, n_dropped, keep array<struct<word int, bits long>>).

    Bit ``i % 64`` of word ``i / 64`` is set when line ``i`` stays. Words whose
    lines all stay are absent, and so are documents that lose nothing.
    """
    spark = docs.sparkSession
    rows = materialize(line_hashes(docs, min_chars), "lines")
    total = rows.count()
    heavy = (
        rows.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("heavy_first"))
        .where(F.col("n") > max(1000, total // HEAVY_PARTS))
        .drop("n")
    )
    heavy = materialize(heavy, "heavy-lines")  # at most HEAVY_PARTS rows
    marked = rows.join(F.broadcast(heavy), ["h1", "h2"], "left").withColumn(
        "salt", F.when(F.col("heavy_first").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    )
    ranged = marked.repartitionByRange(partitions(spark), "h1", "salt")
    stream = Window.partitionBy("h1", "salt", "h2").orderBy("doc_id", "pos")
    first = F.coalesce(F.col("heavy_first"), F.first("doc_id").over(stream))
    repeats = ranged.withColumn("first_doc", first).where(F.col("doc_id") > F.col("first_doc"))
    words = repeats.groupBy("doc_id", "tk", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("bits")
    )
    packed = words.groupBy("doc_id", "tk").agg(
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("keep"),
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
    )
    return packed.select("doc_id", "tk", "n_dropped", "keep")


def apply(docs: DataFrame, bitmaps: DataFrame, into: str = "kept_text") -> DataFrame:
    """``docs`` with the kept lines of each text joined by a line feed, plus n_lines and n_dropped."""
    own = [c for c in docs.columns if c not in (into, "n_lines", "n_dropped")]
    # every word of the bitmap up to its last, before the join, so that it is unpacked once a document
    unpacked = bitmaps.withColumn("words", F.map_from_entries("keep")).withColumn("last", F.element_at("keep", -1)["word"])
    dense = F.expr("transform(sequence(0, last), w -> coalesce(try_element_at(words, w), -1L))")
    side = unpacked.select("doc_id", "tk", "n_dropped", dense.alias("dense"))
    # whatever the columns are called, they travel in one
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col("doc_id").alias("d"), text_key().alias("k"), F.col("text").alias("t"))
    joined = rows.join(side, (F.col("d") == F.col("doc_id")) & (F.col("k") == F.col("tk")), "left")
    # the tested bit depends on the lambda's own index, which only the SQL form passes to getbit
    kept = F.expr("filter(split(coalesce(t, ''), '\\n', -1), (x, i) -> getbit(coalesce(get(dense, cast(i div 64 as int)), -1L), cast(i % 64 as int)) = 1)")
    text = F.when(F.col("dense").isNull(), F.coalesce("t", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *(F.col("row").getField(c).alias(c) for c in own),
        text.alias(into), F.size(split_lines(F.col("t"))).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply(docs, keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(32)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k
), judged AS (
  SELECT keyed.doc_id, pos, line, coalesce(keyed.doc_id > first_doc, false) AS dropped
  FROM keyed LEFT JOIN firsts ON keyed.k = firsts.k
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
