"""Benchmark decontamination: spaced-seed hashing.

Two fixed masks pick six of eight or nine consecutive words and ignore the rest,
so a substituted word on an ignored place doesn't change the hash. Together
they meet every passage of ``SPAN`` words of which at most two differ. Hashes
of the documents' words under each mask are joined with those of the benchmark
items; a hit gives a diagonal (document, item, offset), on which all words are
then compared: the document is contaminated by the item if at least ``NEED`` of
some ``SPAN`` consecutive places hold equal words (0.8 or more). Items shorter than ``SPAN``
words must occur whole; items under ``SHORTEST`` words are not looked for.

Scale. The benchmark is a stated query set: it is read in blocks of at most
``block_words`` words (one for any usual benchmark), each block's index is
bounded by that and sent to the executors, and the documents make one narrow
pass per block, without a shuffle of theirs. In the pass a bit table of the low
hash bits turns nearly all places away before the sorted lookup. Only hits
leave the pass; per document they are summed by a partial aggregate.

Defined cases. A-Z count as a-z. Null text or item has no words. Items that
repeat count by item_id; an item with a null item_id is no part of the verdicts,
which name items, but ``clean`` looks for it like any other. Rows with a null doc_id are
judged like others; rows that repeat get the verdict of all rows of that doc_id
and text. Ties go to the smallest item_id. Extra columns pass ``clean`` through.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm._store import materialize, text_key
from skein.llm._words import Words, gram_weights, grams, slices, word_hashes
from skein.session import table

MASKS = ("11101011", "110100111")
SPAN, NEED, SHORTEST = 13, 11, 5
TABLE_BITS = 22


def _weights(mask: str) -> np.ndarray:
    return gram_weights(len(mask)) * np.array([int(c) for c in mask], np.uint64)


@dataclass
class Block:
    """Indexed words of some items."""

    items: np.ndarray
    words: Words
    seeds: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # weights, sorted hashes, places, bit table

    @classmethod
    def of(cls, items: list[int], texts: list[str | None]) -> Block:
        words = word_hashes(pa.array(texts, pa.string()), fold=True)
        sizes = np.diff(words.bounds)
        owner = words.owner()
        seeds = []
        for w in [_weights(m) for m in MASKS] + [gram_weights(n) for n in range(SHORTEST, SPAN)]:
            h, place = grams(words, len(w), w)
            size = sizes[owner[place]]
            keep = size >= SPAN if (w == 0).any() else size == len(w)
            h, place = h[keep], place[keep]
            if len(h):
                order = np.argsort(h, kind="stable")
                bits = np.zeros(1 << TABLE_BITS, bool)
                bits[(h & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)] = True
                seeds.append((w, h[order], place[order], bits))
        return cls(np.array(items, np.int64), words, seeds)

    def hits(self, docs: Words) -> Iterator[tuple[int, int, int]]:
        """(document, item_id, equal words) of every contaminating diagonal."""
        doc_of, item_of = docs.owner(), self.words.owner()
        found: list[np.ndarray] = []
        for w, hashes, places, bits in self.seeds:
            h, at = grams(docs, len(w), w)
            maybe = bits[(h & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)]
            h, at = h[maybe], at[maybe]
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            n = high - low
            if not n.sum():
                continue
            place = places[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            at = np.repeat(at, n)
            found.append(np.stack([doc_of[at], item_of[place], at - place], 1))
        if not found:
            return
        for doc, item, shift in np.unique(np.concatenate(found), axis=0).tolist():
            a = max(self.words.bounds[item], docs.bounds[doc] - shift)
            b = min(self.words.bounds[item + 1], docs.bounds[doc + 1] - shift)
            same = docs.hashes[a + shift : b + shift] == self.words.hashes[a:b]
            where = np.flatnonzero(same)
            size = int(self.words.bounds[item + 1] - self.words.bounds[item])
            need, span = (NEED, SPAN) if size >= SPAN else (size, size)
            if len(where) >= need and (where[need - 1 :] - where[: len(where) - need + 1] < span).any():
                yield doc, int(self.items[item]), len(where)


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[Block]:
    """The benchmark, block by block; the driver holds one block's texts at a time."""
    items, texts, size = [], [], 0
    for r in benchmark.where("item_id IS NOT NULL").select("item_id", "text").toLocalIterator():
        n = len((r.text or "").split()) + 1
        if items and size + n > block_words:
            yield Block.of(items, texts)
            items, texts, size = [], [], 0
        items.append(r.item_id)
        texts.append(r.text)
        size += n
    if items:
        yield Block.of(items, texts)


def overlaps(docs: DataFrame, benchmark: DataFrame, block_words: int = 1_000_000) -> DataFrame:
    """(doc_id, tk, item_id, overlap): contaminated pairs, with the most equal words on one diagonal."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tk"), "text")
    parts = []
    for block in item_blocks(benchmark, block_words):

        def run(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    got = list(block.hits(word_hashes(part.column("text"), fold=True)))
                    if got:
                        own, items, n = zip(*got, strict=True)
                        take = pa.array(own, pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id").take(take), part.column("tk").take(take), pa.array(items, pa.int64()), pa.array(n, pa.int64())],
                            ["doc_id", "tk", "item_id", "overlap"],
                        )

        parts.append(materialize(keyed.mapInArrow(run, "doc_id long, tk long, item_id long, overlap long"), "overlaps"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id long, tk long, item_id long, overlap long")
    return functools.reduce(DataFrame.union, parts).groupBy("doc_id", "tk", "item_id").agg(F.max("overlap").alias("overlap"))


def verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, item_id, overlap) per row: the item with the largest overlap."""
    pairs = overlaps(docs, benchmark)
    worst = pairs.groupBy("doc_id", "tk").agg(
        F.count(F.lit(1)).alias("n_items"), F.min(F.struct((-F.col("overlap")).alias("o"), "item_id")).alias("best")
    )
    side = worst.select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), "n_items", "best")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tk"))
    out = rows.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk")), "left")
    return out.select(
        "doc_id", F.col("_tk").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.col("best.item_id").alias("item_id"), F.coalesce(-F.col("best.o"), F.lit(0)).cast("long").alias("overlap"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, block_words: int = 1_000_000) -> DataFrame:
    """``docs`` without contaminated rows: one narrow pass per block, no shuffle."""
    for block in item_blocks(benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), "text"), block_words):

        def run(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    keep = np.ones(part.num_rows, bool)
                    for own, _, _ in block.hits(word_hashes(part.column("text"), fold=True)):
                        keep[own] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents)
), bw AS (
  SELECT item_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark)
), m AS (
  SELECT doc_id, item_id, n, i - p AS shift, p FROM dw JOIN bw USING (w) WHERE n >= 5
), long_enough AS (
  SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, shift) >= least(n, 11)
), spans AS (
  SELECT doc_id, item_id, n, shift, count(*) OVER d AS overlap,
         count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS inside
  FROM long_enough WINDOW d AS (PARTITION BY doc_id, item_id, shift)
), pairs AS (
  SELECT doc_id, item_id, max(overlap) AS overlap FROM spans WHERE inside >= least(n, 11) AND (n >= 13 OR overlap = n)
  GROUP BY doc_id, item_id
), best AS (
  SELECT doc_id, count(*) AS n_items, arg_min(item_id, (-overlap, item_id)) AS item_id, max(overlap) AS overlap FROM pairs GROUP BY doc_id
)
SELECT d.doc_id, b.doc_id IS NOT NULL AS contaminated, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, item_id,
       CAST(coalesce(overlap, 0) AS BIGINT) AS overlap
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id
"""
