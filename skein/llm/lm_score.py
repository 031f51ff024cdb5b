"""LM scoring: weighted backoff automaton.

A smoothed trigram model of the training documents is an automaton. Its states
are the contexts that occur (two words, one word, none: the root), an arc carries
a word's log10 probability and leads to the longest context that its end matches,
and every state but the root has a failure arc to the next shorter context with
the state's backoff weight. One left-to-right traversal of a text carries the
state and adds up the weights. An arc from state h by w weighs
``(c(h w) + K * p(w | h')) / (c(h) + K)``, h' the state that h fails to, and the
failure arc ``K / (c(h) + K)``; so every state's distribution sums to 1 over the
known words and one class of unknown ones. The root is the smoothed unigram model
``(c + 0.5) / (N + 0.5 * (V + 1))``.

What is learned. Every word, pair and triple of the training documents is
counted, whatever its count and the size of the corpus: nothing is dropped, and
no part of the model is sent to all executors.

Scale. Documents are read once, into pieces of about ``PIECE_BYTES`` of text that
hold word numbers and the piece's distinct word hashes. For each order a piece
sends its distinct n-grams with their training counts to hash buckets (blobs of
sorted keys, 6 bytes each beside the bits that the bucket implies); a bucket sums
the counts of all pieces and answers each of them for its own n-grams. A frequent
n-gram is one key per piece, so no bucket is hot. From its answers a piece builds
the part of the automaton that its texts can reach, with the weights of the whole,
and walks it. Buckets grow in number with the corpus, a task holds one bucket or
one piece. Two n-grams of a bucket share a key with a chance of about 1e-8, the
same at any size.

Defined cases. Null text is empty: one token, the end. Without training
documents every token has probability 1 in the root. A null doc_id counts as
training. Rows that repeat are scored alike, and count each time in training.
Ties do not arise. Extra columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm._runs import run_bounds, runs, trimmed
from skein.llm._store import free_shuffles, materialize, partitions
from skein.llm._words import mix64, slices, word_hashes
from skein.session import table

END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Weight of the shorter context's distribution, in occurrences, for contexts of one and of two words (the best of a coarse grid on held-out texts).
K1, K2 = 200.0, 10.0
PIECE_BYTES = 3 << 20
#: n-grams that a bucket is sized for.
BUCKET = 1_000_000
KEY_BITS = 48
_MULT = [np.uint64(x) | np.uint64(1) for x in np.random.default_rng(503).integers(1 << 61, 1 << 63, 3, dtype=np.uint64)]


def sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, bounds): each text's words and then the end."""
    words = word_hashes(texts, fold=True)
    n = len(words.bounds) - 1
    bounds = words.bounds + np.arange(n + 1)
    out = np.full(bounds[-1], END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[bounds[1:] - 1] = False
    out[inside] = words.hashes
    return out, bounds


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _narrow(n: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold them all."""
    top = int(n.max(initial=0))
    return _blob(n.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max)))


def _wide(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(raw) // size]).astype(np.int64) if size else np.zeros(0, np.int64)


PIECES = "piece long, doc_ids array<long>, bounds binary, words binary, tokens binary, taught binary"


def pieces(docs: DataFrame, training: Column) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): documents, token bounds, distinct word hashes, word numbers, which documents teach."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(training, F.lit(False)).alias("teaches"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        kept: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            words, tokens = np.unique(np.concatenate([x[1] for x in kept]), return_inverse=True)
            sizes = np.concatenate([np.diff(x[2]) for x in kept])
            bounds = np.append(0, np.cumsum(sizes))
            ids = pa.concat_arrays([x[0] for x in kept])
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            blobs = (_blob(bounds), _blob(words), _blob(tokens.astype(np.uint32)), _blob(np.concatenate([x[3] for x in kept])))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), lists, *(pa.array([x], pa.binary()) for x in blobs)], ["piece", "doc_ids", "bounds", "words", "tokens", "taught"])

        size = 0
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, bounds = sequences(part.column("text"))
                kept.append((part.column("doc_id"), tokens, bounds, np.asarray(part.column("teaches"))))
                size += len(tokens) * 6
                if size >= PIECE_BYTES:
                    yield packed()
                    kept, size, number = [], 0, number + 1
        if kept:
            yield packed()

    return rows.mapInArrow(trimmed(run), PIECES)


@dataclass
class Piece:
    """Texts as one padded sequence of word numbers: a start before each text, ``own`` the places of its tokens."""

    bounds: np.ndarray
    words: np.ndarray  # hashes; the last one is the start's
    ids: np.ndarray
    own: np.ndarray
    taught: np.ndarray  # per token

    @classmethod
    def of(cls, bounds: pa.Buffer, words: pa.Buffer, tokens: pa.Buffer, taught: pa.Buffer) -> Piece:
        at = np.frombuffer(bounds, np.int64)
        hashes = np.append(np.frombuffer(words, np.uint64), START)
        n = len(at) - 1
        numbers = np.frombuffer(tokens, np.uint32).astype(np.int64)
        ids = np.full(len(numbers) + n, len(hashes) - 1, np.int64)
        own = np.arange(len(numbers)) + np.repeat(np.arange(1, n + 1), np.diff(at))
        ids[own] = numbers
        return cls(at, hashes, ids, own, np.repeat(np.frombuffer(taught, bool), np.diff(at)))

    def keys(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(token, hash of the n-gram that ends with it) where the text, its start included, is long enough."""
        at = np.arange(len(self.own))
        if order == 3:
            at = at[self.ids[self.own - 1] != len(self.words) - 1]
        h = self.words[self.ids[self.own[at]]] * _MULT[0]
        for j in range(1, order):
            h = h + self.words[self.ids[self.own[at] - j]] * _MULT[j]
        return at, mix64(h + np.uint64(order))


def _split(keys: np.ndarray, bits: int) -> np.ndarray:
    """Keys of ``bits`` bits of bucket and ``KEY_BITS`` more, or what 64 bits leave."""
    return keys >> np.uint64(max(0, 64 - KEY_BITS - bits))


def _sums(made: DataFrame, orders: tuple[int, ...], bits: int) -> DataFrame:
    """(piece, order, bucket, counts): for each piece the training counts of its distinct n-grams, sorted by key, by bucket;
    with piece -1 a row per bucket of words: how many of them occur in training."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                piece = Piece.of(*(batch.column(c)[k].as_buffer() for c in ("bounds", "words", "tokens", "taught")))
                for order in orders:
                    at, keys = piece.keys(order)
                    keys = _split(keys, bits)
                    distinct = np.unique(keys)
                    known, n = np.unique(keys[piece.taught[at]], return_counts=True)
                    counts = np.zeros(len(distinct), np.int64)
                    counts[np.searchsorted(distinct, known)] = n
                    bucket = (distinct >> np.uint64(min(KEY_BITS, 64 - bits))).astype(np.int64)
                    cuts = run_bounds(bucket)
                    low = distinct.view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((order << 40) + bucket[cuts[:-1]], pa.int64()), pa.array(np.full(len(cuts) - 1, batch.column("piece")[k].as_py()), pa.int64()),
                            pa.array([_blob(low[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                            pa.array([_narrow(counts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                        ],
                        ["bucket", "piece", "keys", "counts"],
                    )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "bucket"):
            every = run_bounds(rows.column("bucket").to_numpy())
            for s, e in zip(every, every[1:], strict=False):
                part = rows.slice(s, e - s)
                bucket = part.column("bucket")[0].as_py()
                blobs, counts = part.column("keys").to_pylist(), part.column("counts").to_pylist()
                sizes = [len(x) * 8 // KEY_BITS for x in blobs]
                keys = np.zeros((sum(sizes), 8), np.uint8)
                keys[:, : KEY_BITS // 8] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, KEY_BITS // 8)
                keys = keys.view(np.uint64)[:, 0]
                order = np.argsort(keys)
                new = keys[order[1:]] != keys[order[:-1]]
                which = np.append(0, np.cumsum(new))
                n = np.concatenate([_wide(x, k) for x, k in zip(counts, sizes, strict=True)])
                sums = np.add.reduceat(n[order], np.append(0, np.flatnonzero(new) + 1))
                n[order] = sums[which]
                cuts = np.cumsum([0, *sizes]).tolist()
                made = [_narrow(n[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                asked = part.column("piece").to_pylist()
                if bucket >> 40 == 1:
                    made.append(_blob(np.array([(sums > 0).sum()], np.int64)))
                    asked.append(-1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked, pa.int64()), pa.array([bucket >> 40] * len(asked), pa.int32()), pa.array([bucket & ((1 << 40) - 1)] * len(asked), pa.int64()), pa.array([*sizes, 1][: len(asked)], pa.int64()), pa.array(made, pa.binary())],
                    ["piece", "order", "bucket", "size", "counts"],
                )

    asked = made.select("piece", "bounds", "words", "tokens", "taught").mapInArrow(trimmed(ask), "bucket long, piece long, keys binary, counts binary")
    dealt = asked.repartition(partitions(made.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(trimmed(answer), "piece long, order int, bucket long, size long, counts binary")


@dataclass
class Automaton:
    """The part of the automaton that a piece's texts can reach.

    Contexts and arcs are n-grams of the piece; the arrays give, for each token,
    the counts of the n-grams that end there.
    """

    piece: Piece
    tokens: int  # of training
    kinds: int
    texts: int
    counts: dict[int, np.ndarray]  # by order, per token of the piece; 0 where the text is too short

    def states(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token the state before it: how many words of context it holds, and the counts of its last word and last two."""
        one, two = self.counts[1], self.counts[2]
        first = np.zeros(len(one), bool)
        first[self.piece.bounds[:-1]] = True
        c1, c2 = np.append(0, one[:-1]), np.append(0, two[:-1])
        c1[first], c2[first] = self.texts, 0  # the start is a context of its own
        return np.where(c2 > 0, 2, np.where(c1 > 0, 1, 0)), c1, c2

    def traverse(self) -> tuple[np.ndarray, np.ndarray]:
        """Per token (weight of its root arc, weight of the path taken)."""
        with np.errstate(divide="ignore"):
            root = (self.counts[1] + 0.5) / (self.tokens + 0.5 * (self.kinds + 1))
        state, c1, c2 = self.states()
        # arcs by the word from the state's one-word context, if there is one, and from its two words
        arc1 = (self.counts[2] + K1 * root) / (c1 + K1)
        arc2 = (self.counts[3] + K2 * arc1) / (c2 + K2)
        weight = np.zeros(len(root))
        at = state.copy()
        live = np.ones(len(root), bool)
        for level, arc, have, fail in ((2, arc2, self.counts[3] > 0, np.log10(K2 / (c2 + K2))), (1, arc1, self.counts[2] > 0, np.log10(K1 / (c1 + K1)))):
            here = live & (at == level)
            taken = here & have
            weight[taken] += np.log10(arc[taken])
            live &= ~taken
            failed = here & ~have  # the failure arc
            weight[failed] += fail[failed]
            at[failed] = np.where(c1[failed] > 0, level - 1, 0)
        weight[live] += np.log10(root[live])
        return np.log10(root), weight


def score(docs: DataFrame, training: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``, by the model of its rows that meet ``training``."""
    spark = docs.sparkSession
    made = materialize(pieces(docs.select("doc_id", "text"), training), "pieces")
    sizes = made.select(F.col("piece"), F.expr("octet_length(tokens) div 4").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # about two thirds of the n-grams of a piece are distinct
    bits = max(0, int(max(partitions(spark), total // BUCKET) - 1).bit_length())
    answers = []
    for orders in ((1, 2), (3,)):
        answers.append(materialize(_sums(made, orders, bits), "answers"))
        free_shuffles(spark)
    stats = made.select("bounds", "taught").mapInArrow(_taught, "tokens long, texts long").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("texts"), F.lit(0)).alias("texts")).first()
    kinds = answers[0].where("piece = -1").select("counts").mapInArrow(_total, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tokens, texts = stats.tokens, stats.texts
    held = made.select("piece", F.lit(0).alias("order"), F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("binary").alias("counts"), "doc_ids", "bounds", "words", "tokens", "taught")
    told = answers[0].where("piece >= 0").union(answers[1]).select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("doc_ids", "array<long>"), ("bounds", "binary"), ("words", "binary"), ("tokens", "binary"), ("taught", "binary"))))
    rows = held.union(told).repartition(partitions(spark), "piece").sortWithinPartitions("piece", "order", "bucket")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "piece"):
            every = run_bounds(group.column("piece").to_numpy())
            for s, e in zip(every, every[1:], strict=False):
                part = group.slice(s, e - s)
                piece = Piece.of(*(part.column(c)[0].as_buffer() for c in ("bounds", "words", "tokens", "taught")))
                doc_ids = part.column("doc_ids")[0].values
                order, counted, size = part.column("order").to_numpy(), part.column("counts").to_pylist(), part.column("size").to_numpy()
                counts = {}
                for k in (1, 2, 3):
                    at, keys = piece.keys(k)
                    keys = _split(keys, bits)
                    by = np.argsort(keys)
                    which = np.append(0, np.cumsum(keys[by[1:]] != keys[by[:-1]])) if len(by) else by
                    got = [_wide(counted[i], size[i]) for i in np.flatnonzero(order == k)]
                    counts[k] = np.zeros(len(piece.own), np.int64)
                    if len(by):
                        counts[k][at[by]] = np.concatenate(got)[which]
                root, weight = Automaton(piece, tokens, kinds, texts, counts).traverse()
                starts = piece.bounds[:-1]
                known = np.add.reduceat((counts[1] > 0).astype(np.int64), starts)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(np.diff(piece.bounds)), pa.array(known), pa.array(np.add.reduceat(root, starts)), pa.array(np.add.reduceat(weight, starts))],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    out = rows.mapInArrow(trimmed(walk), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bounds, taught in zip(batch.column("bounds").to_pylist(), batch.column("taught").to_pylist(), strict=True):
            teaches = np.frombuffer(taught, bool)
            n = int(np.diff(np.frombuffer(bounds, np.int64))[teaches].sum())
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([int(teaches.sum())])], ["tokens", "texts"])


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(x, "little") for x in batch.column("counts").to_pylist()], pa.int64())], ["n"])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(5)) == 1, F.lit(False))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, ~held_out())
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
