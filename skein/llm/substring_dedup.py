"""Substring dedup: relative Lempel-Ziv parsing against indexed reference blocks.

A window is ``window`` consecutive words. A word goes when some window that
covers it also starts at another place, in the same document or another.

Reference. The corpus is its own reference. Every window names an anchor: the
leftmost smallest hash among its ``seed``-word grams, which depends on the
window's words alone, so equal windows name equal anchors, at the same distance
from their start. The phrases around anchors that occur more than once (all
windows that name one occurrence) are the reference; nothing else can hold a
repeated window. It is cut into blocks by anchor hash, and a block's index is the
suffix order of its phrases, whose symbols are window hashes.

Parsing. A document's phrases go to the blocks of their anchors, so it is
factored against every block that can match it without visiting the others. The
parse of a phrase is greedy: at the first window that another place of the block
holds too it takes the longest match, which stands beside the phrase in the
suffix order, and emits a factor (reference document, position there, words
start to end); it goes on behind the match. As a symbol is a whole window, the
next factor starts with the window that crosses the last one's end, which is the
check at the boundary: no repeated window between two factors is passed over. A
factor that ends with its phrase goes on in the block of the next anchor. The
union of a document's factors makes its duplicate spans.

Scale. One narrow pass finds anchors (about 2 / (window - seed + 2) of the
words); their counts are a partial aggregate; only phrases of repeated anchors
are shuffled, once, as window hashes. An anchor of more than ``hot`` places is
not gathered: its reference is a table of distinct windows with two places each,
made by a partial aggregate, and its phrases are factored along those places
after a join that adaptive execution may split. Equality is on 128 bits (anchor
and window). Blocks are dealt straight from a written table: behind a join on
the same key Spark leaves a repartition out, and adaptive execution may then
split an anchor over tasks.

Defined cases. Null or short text has no window and loses nothing. Rows with a
null doc_id take part like others. Rows that repeat (also with equal doc_id)
are different places, so their windows are repeats. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm._store import discard, free_shuffles, materialize, partitions, text_key
from skein.llm._words import Words, grams, mix64, slices, word_hashes
from skein.session import table


def window_anchors(words: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window start, anchor place, anchor hash) of every window, places as word numbers of the batch."""
    width = window - seed + 1
    total = len(words.hashes)
    none = np.zeros(0, np.int64)
    if total < window:
        return none, none, np.zeros(0, np.uint64)
    found, place = grams(words, seed)
    h = np.full(total, np.uint64(0xFFFFFFFFFFFFFFFF))
    h[place] = found
    best, at, span = h, np.arange(total), 1
    while span * 2 <= width:
        m = len(best) - span
        less = best[span:] < best[:m]
        best, at, span = np.where(less, best[span:], best[:m]), np.where(less, at[span:], at[:m]), span * 2
    rest = width - span
    if rest:
        m = len(best) - rest
        less = best[rest:] < best[:m]
        best, at = np.where(less, best[rest:], best[:m]), np.where(less, at[rest:], at[:m])
    sizes = np.diff(words.bounds)
    room = np.maximum(sizes - window + 1, 0)
    starts = np.repeat(words.bounds[:-1] - np.append(0, np.cumsum(room)[:-1]), room) + np.arange(room.sum())
    return starts, at[starts], best[starts]


def anchors(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(g, doc_id, tk, pos): every anchor once; pos counts the document's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = word_hashes(part.column("text"), fold=False)
                _, at, g = window_anchors(words, window, seed)
                if len(at):
                    new = np.append(True, at[1:] != at[:-1])
                    at, g = at[new], g[new]
                own = words.owner()[at]
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), part.column("doc_id").take(take), part.column("tk").take(take), pa.array((at - words.bounds[own]).astype(np.int32))],
                    ["g", "doc_id", "tk", "pos"],
                )

    return docs.mapInArrow(run, "g long, doc_id long, tk long, pos int")


def phrases(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(g, doc_id, tk, start, lead, hot, windows) of the anchors in each row's ``places`` and ``hot_places``: hashes of the
    windows that name the anchor; ``lead``: how many earlier windows could have named it."""
    width = window - seed + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = word_hashes(part.column("text"), fold=False)
                starts, at, g = window_anchors(words, window, seed)
                kind = np.zeros(len(words.hashes) + 1, np.int8)
                for mark, column in ((1, "places"), (2, "hot_places")):
                    lists = part.column(column)
                    sizes = np.diff(np.asarray(lists.offsets, np.int64))
                    kind[np.repeat(words.bounds[:-1], sizes) + np.asarray(lists.flatten(), np.int64)] = mark
                keep = kind[at] > 0
                starts, at, g = starts[keep], at[keep], g[keep]
                if not len(at):
                    continue
                by = grams(words, window)
                hashes = by[0][np.searchsorted(by[1], starts)]
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                own = words.owner()[at[first]]
                take = pa.array(own)
                ends = np.append(first, len(at)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(g[first].view(np.int64)), part.column("doc_id").take(take), part.column("tk").take(take),
                        pa.array((starts[first] - words.bounds[own]).astype(np.int32)), pa.array((starts[first] - at[first] + width - 1).astype(np.int32)),
                        pa.array(kind[at[first]] == 2), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64))),
                    ],
                    ["g", "doc_id", "tk", "start", "lead", "hot", "windows"],
                )

    return docs.mapInArrow(run, "g long, doc_id long, tk long, start int, lead int, hot boolean, windows array<long>")


class ReferenceBlock:
    """Phrases of some anchors, as rows of window symbols, with their suffix order.

    Equal windows stand at the same distance from their anchors, so two phrases
    match column by column, and one order per column is the suffix array.
    """

    def __init__(self, g: np.ndarray, lead: np.ndarray, sizes: np.ndarray, windows: np.ndarray, width: int):
        n = len(g)
        owner = np.repeat(np.arange(n), sizes)
        column = lead[owner] + np.arange(len(windows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # a place without a window equals no other
        self.symbols = mix64(np.arange(n * width, dtype=np.uint64) ^ np.uint64(0xA5A5A5A55A5A5A5A)).reshape(n, width)
        self.symbols[owner, column] = windows.view(np.uint64)
        keys = mix64(self.symbols ^ (g.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None])
        self.above, self.below = (np.full((n, width), -1, np.int32) for _ in range(2))
        self.held_from = np.full((n, width + 1), width, np.int32)  # the next column that another phrase holds too
        rank = np.zeros(n, np.int64)
        for c in range(width - 1, -1, -1):
            key = keys[:, c]
            order = np.lexsort((rank, key))
            key, last = key[order], rank[order]
            same = key[1:] == key[:-1]
            rank[order] = np.append(0, np.cumsum(~same | (last[1:] != last[:-1])))
            self.above[order[1:], c] = np.where(same, order[:-1], -1)
            self.below[order[:-1], c] = np.where(same, order[1:], -1)
            held = np.zeros(n, bool)
            held[order[1:]] = same
            held[order[:-1]] |= same
            self.held_from[:, c] = np.where(held, c, self.held_from[:, c + 1])

    def match(self, row: np.ndarray, at: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Length of the match of each row from its column with another row; 0 where that is -1."""
        columns = np.arange(self.symbols.shape[1])
        ends = (self.symbols[row] != self.symbols[other]) & (columns >= at[:, None])
        ends = np.where(ends.any(1), ends.argmax(1), len(columns))
        return np.where(other < 0, 0, ends - at)

    def factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, length, reference row) of the greedy parse of every phrase."""
        out = [tuple(np.zeros(0, np.int64) for _ in range(4))]
        row = np.arange(len(self.symbols))
        at = self.held_from[:, 0].astype(np.int64)
        width = self.symbols.shape[1]
        while True:
            row, at = row[at < width], at[at < width]
            if not len(row):
                return tuple(np.concatenate(x) for x in zip(*out, strict=True))
            up, down = self.above[row, at], self.below[row, at]
            by_up, by_down = self.match(row, at, up), self.match(row, at, down)
            length = np.maximum(by_up, by_down)
            out.append((row, at, length, np.where(by_up >= by_down, up, down)))
            at = self.held_from[row, at + length].astype(np.int64)


FACTOR = "doc_id long, tk long, s int, e int, ref_doc long, ref_pos int"


def factor_blocks(found: DataFrame, window: int, seed: int) -> DataFrame:
    """(doc_id, tk, s, e, ref_doc, ref_pos): factors of the phrases in a written table against the block of their anchors; s, e and ref_pos count words."""
    width = window - seed + 1

    def parse(rows: pa.Table) -> pa.RecordBatch:
        lists = rows.column("windows").combine_chunks()
        sizes = np.diff(np.asarray(lists.offsets, np.int64))
        start, lead = (rows.column(c).to_numpy().astype(np.int64) for c in ("start", "lead"))
        block = ReferenceBlock(rows.column("g").to_numpy(), lead, sizes, np.asarray(lists.flatten(), np.int64), width)
        row, at, length, ref = block.factors()
        s = start[row] + at - lead[row]
        take, take_ref = pa.array(row), pa.array(ref)
        doc_id, tk = (rows.column(c).combine_chunks() for c in ("doc_id", "tk"))
        return pa.RecordBatch.from_arrays(
            [
                doc_id.take(take), tk.take(take), pa.array(s.astype(np.int32)), pa.array((s + length - 1 + window).astype(np.int32)),
                doc_id.take(take_ref), pa.array((start[ref] + at - lead[ref]).astype(np.int32)),
            ],
            ["doc_id", "tk", "s", "e", "ref_doc", "ref_pos"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            size += batch.num_rows
            g = batch.column("g").to_numpy()
            if size < 50_000 or g[0] == g[-1]:
                continue
            last = int(np.flatnonzero(g != g[-1])[-1]) + 1  # the last anchor's rows may go on in the next batch
            kept[-1] = batch.slice(0, last)
            yield parse(pa.Table.from_batches(kept))
            kept, size = [batch.slice(last)], batch.num_rows - last
        if size:
            yield parse(pa.Table.from_batches(kept))

    blocks = found.select("g", "doc_id", "tk", "start", "lead", "windows").repartition(partitions(found.sparkSession), "g").sortWithinPartitions("g")
    return blocks.mapInArrow(run, FACTOR)


def factor_hot(found: DataFrame, window: int) -> DataFrame:
    """The same for anchors with too many places for one task: along the places that a table of distinct windows names."""
    each = found.select("g", "doc_id", "tk", "start", F.posexplode("windows").alias("o", "w"))
    each = each.withColumn("at", F.struct("doc_id", "tk", (F.col("start") + F.col("o")).alias("pos")))
    index = each.groupBy("g", "w").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    index = materialize(index.where("n > 1").drop("n"), "hot-windows")
    ref = F.when(F.col("at").eqNullSafe(F.col("lo")), F.col("hi")).otherwise(F.col("lo"))
    held = each.join(index, ["g", "w"]).select("doc_id", "tk", "start", "o", ref.alias("ref")).distinct()
    # a factor: windows in a row that go on at the same reference
    held = held.withColumn("shift", F.col("ref.pos") - F.col("o"))
    along = Window.partitionBy("doc_id", "tk", "start", "ref.doc_id", "ref.tk", "shift").orderBy("o")
    held = held.withColumn("run", F.col("o") - F.row_number().over(along))
    runs = held.groupBy("doc_id", "tk", "start", F.col("ref.doc_id").alias("ref_doc"), F.col("ref.tk").alias("ref_tk"), "shift", "run")
    runs = runs.agg(F.min("o").alias("a"), F.max("o").alias("b"))
    return runs.select(
        "doc_id", "tk", (F.col("start") + F.col("a")).alias("s"), (F.col("start") + F.col("b") + window).alias("e"), "ref_doc", (F.col("shift") + F.col("a")).alias("ref_pos")
    )


def factors(docs: DataFrame, window: int = 35, seed: int = 10, hot: int = 50_000) -> DataFrame:
    """(doc_id, tk, s, e, ref_doc, ref_pos): the parse of ``docs`` (doc_id, text) relative to all of them, factors of a window or more."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tk"), "text")
    all_anchors = materialize(anchors(keyed, window, seed), "anchors")
    # a written table, so that the join may split a hot anchor's rows
    counts = materialize(all_anchors.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "anchor-counts")
    free_shuffles(spark)
    repeated = materialize(all_anchors.join(counts, "g"), "repeated-anchors")
    discard(all_anchors)
    free_shuffles(spark)
    own = repeated.groupBy(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk")).agg(
        F.collect_set(F.when(F.col("n") <= hot, F.col("pos"))).alias("places"), F.collect_set(F.when(F.col("n") > hot, F.col("pos"))).alias("hot_places")
    )
    hit = keyed.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk"))).select("doc_id", "tk", "text", "places", "hot_places")
    found = materialize(phrases(hit, window, seed), "phrases")
    discard(repeated)
    free_shuffles(spark)
    return factor_blocks(found.where("NOT hot"), window, seed).union(factor_hot(found.where("hot"), window))


def duplicate_spans(docs: DataFrame, window: int = 35, seed: int = 10, hot: int = 50_000) -> DataFrame:
    """(doc_id, tk, spans array<struct<s, e>>) of the documents that hold a repeated window; spans may overlap."""
    return factors(docs, window, seed, hot).groupBy("doc_id", "tk").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): words outside the spans, joined by one space."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tk"), "text")
    own = spans.select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), "spans")
    joined = keyed.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk")), "left")
    rows = joined.select("doc_id", "text", F.col("spans.s").alias("s"), F.col("spans.e").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, gone, texts = [], [], []
                for text, s, e in zip(*(part.column(c).to_pylist() for c in ("text", "s", "e")), strict=True):
                    words = (text or "").encode().split()
                    n.append(len(words))
                    if s:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, s, 1)
                        np.add.at(edge, e, -1)
                        keep = np.cumsum(edge[:-1]) == 0
                        words = [words[i] for i in np.flatnonzero(keep).tolist()]
                    gone.append(n[-1] - len(words))
                    texts.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_spans(docs, duplicate_spans(docs))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, p, list_slice(ws, p, p + 34) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS p FROM w WHERE len(ws) >= 35)
), rep AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY md5(array_to_string(g, ' '))) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, p + o AS i FROM rep, range(0, 35) r(o)
), each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN (
  SELECT each.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY each.i) FILTER (WHERE gone.i IS NULL) AS kept
  FROM each LEFT JOIN gone ON each.doc_id = gone.doc_id AND each.i = gone.i GROUP BY each.doc_id
) k ON w.doc_id = k.doc_id
"""
