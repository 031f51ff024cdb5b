"""Token-ID / binary output: frequency-ranked ids in byte-aligned variable-length coding.

Texts become ids of a given tokenizer; ids are replaced by their frequency rank
over the whole corpus (the commonest id is 0) and written with separate control
bytes: two bits per id say how many bytes its rank takes, four ids to a control
byte, and the rank bytes follow without any framing. A reader turns control
bytes into lengths with a 256-row table, and data into ranks with one masked
copy in numpy; there is no loop over ids.

File format of a shard (little-endian): ``SKT1``, u64 documents, u64 ids, then
i64 doc ids, u8 flags (1: the doc id is null), u64 ids per document, control
bytes, data bytes. ``ranks.tbl``: ``SKR1``, u64 count, u32 id of each rank. ``manifest``: Parquet with
each shard's range and number of ids.
Shards are named ``<range>-<first row>.svb``; in name order they hold the corpus
in ascending doc_id order.

Scale. One range shuffle of the texts by doc_id; a task tokenizes its sorted
range and writes compressed ids to the shared folder, so that counting ranks
and writing shards never tokenize again. A shard is a run of rows of one range
of about ``shard_ids`` ids, so no task holds a range. The driver sees one
number per range and one per distinct id (vocabulary bound). Shards are written
under an attempt's own name and then renamed, so a task that runs again after a
lost executor replaces its file by the same bytes.

Defined cases. Null text is empty and yields the end id alone. Rows with a null
doc_id come first; rows that repeat a doc_id are documents of their own, in the
order of their texts. An empty table yields no shard. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm._runs import trimmed
from skein.llm._store import discard, free_shuffles, materialize, partitions, scratch_path
from skein.llm._words import Lookup, slices, span_hashes, text_bytes
from skein.session import table

_CHUNK = 1 << 16
_MOST = 256  # longer parts aren't remembered

#: Byte classes for cutting texts into parts.
_LETTER, _MARK, _SOLID = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = True
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def part_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the texts in ``raw`` may be cut so that byte-level BPE never looks across.

    Always at a text's start; before a single space between visible characters;
    around a single line feed between visible characters; between a letter and a
    punctuation mark (not an apostrophe, which may begin a contraction). Only
    ASCII and the Latin-1 letters are trusted to be visible.
    """
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw) > 2:
        latin = np.zeros(len(raw), bool)  # second byte of U+00C0-U+00FF
        latin[1:] = raw[:-1] == 0xC3
        letter = _LETTER[raw] | (latin & (raw != 0x97) & (raw != 0xB7))
        shown = _SOLID[raw] | latin  # a visible character ends here
        begins = _SOLID[raw] | (raw == 0xC3)
        alone = shown[:-2] & begins[2:]
        cut[1:-2] = alone & (raw[1:-1] == 0x20)
        feed = alone & (raw[1:-1] == 0x0A)
        cut[1:-2] |= feed
        cut[2:-1] |= feed
        cut[1:-1] |= letter[:-1] & _MARK[raw[1:]]
    cut[offsets] = True
    # the rules looked across the texts' ends; what they cut there is cut anyway, and no other place depends on it
    return np.flatnonzero(cut[:-1])


class Parts:
    """Ids by part hash, in one sorted table: some 30 bytes a part."""

    def __init__(self) -> None:
        self.hashes, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.offsets, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.lookup = Lookup(self.hashes)

    def __len__(self) -> int:
        return len(self.hashes)

    def add(self, hashes: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        entry = np.append(self.entry, len(self.offsets) - 1 + np.arange(len(hashes)))
        every = np.append(self.hashes, hashes)
        order = np.argsort(every)
        self.hashes, self.entry = every[order], entry[order]
        self.offsets = np.append(self.offsets, self.offsets[-1] + np.cumsum(lengths))
        self.ids = np.append(self.ids, ids)
        self.lookup = Lookup(self.hashes)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        at = self.lookup.find(hashes)
        return np.where(at >= 0, self.entry[at], -1) if len(self) else at


class Encoder:
    """Ids of texts by the tokenizers library.

    For a plain byte-level BPE the texts are cut into parts (``part_starts``);
    each distinct part is encoded once by the library and the first ``remember``
    parts are remembered by 64-bit hash. Other tokenizers, and texts that hold an
    added token's string, go through the library whole.
    """

    def __init__(self, path: str, remember: int = 600_000, fresh: int = 1 << 16):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        pre = self.tokenizer.pre_tokenizer
        self.by_part = type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space and self.tokenizer.normalizer is None
        vocabulary = self.tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # in byte-level vocabularies a character stands for a byte
            self.token_bytes[i] = len(token)
        self.known, self.recent = Parts(), Parts()  # the small table takes new parts, the large one takes it over now and then
        self.remember, self.fresh = remember, fresh

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(texts), 256):
            out += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts[at : at + 256], add_special_tokens=False)]
        return out

    def _whole(self, text: str) -> np.ndarray:
        """In chunks that end before a space between letters, where no piece can reach across."""
        out, at = [], 0
        while at < len(text):
            end = min(len(text), at + _CHUNK)
            while self.by_part and end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
                end += 1
            if not self.by_part:
                end = len(text)
            out += self._encode([text[at:end]])
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def _new(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, how many of each). Parts that begin with a space and end visibly are joined: the library cuts
        them apart again, and its tokens' bytes tell where."""
        joins = np.array([len(p) > 1 and p[0] == 0x20 and bool(_SOLID[p[1]] or p[1] == 0xC3) and bool(_SOLID[p[-1]] or p[-2] == 0xC3) for p in parts])
        joined, others = np.flatnonzero(joins), np.flatnonzero(~joins)
        pool, m = [], np.zeros(len(parts), np.int64)
        for at in range(0, len(joined), 4096):
            group = joined[at : at + 4096]
            own = [parts[i] for i in group.tolist()]
            ids = self._encode([b"".join(own).decode()])[0]
            ends = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum([len(p) for p in own])) + 1
            m[group] = np.diff(ends, prepend=0)
            pool.append(ids)
        each = self._encode([parts[i].decode() for i in others.tolist()])
        m[others] = [len(x) for x in each]
        flat, lengths = np.concatenate([*pool, *each]), np.concatenate([m[joined], m[others]])
        begin = np.empty(len(parts), np.int64)
        begin[np.concatenate([joined, others])] = np.cumsum(lengths) - lengths
        ends = np.cumsum(m)
        return flat[np.repeat(begin - (ends - m), m) + np.arange(len(flat))], m

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 bounds)."""
        raw, offsets = text_bytes(texts)
        n = len(offsets) - 1
        if not self.by_part or any(raw.tobytes().find(s) >= 0 for s in self.specials):
            each = [self._whole(t or "") for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.append(0, np.cumsum([len(x) for x in each], dtype=np.int64))
        starts = part_starts(raw, offsets)
        stops = np.append(starts[1:], len(raw))
        usual = stops - starts <= _MOST
        hashes = np.full(len(starts), np.uint64(0), np.uint64)
        hashes[usual] = span_hashes(raw, starts[usual], stops[usual])
        ids, lengths = np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
        pools, where = [], np.zeros(len(starts), np.int64)
        base, open_ = 0, usual.copy()
        for table in (self.known, self.recent):
            look = np.flatnonzero(open_)
            at = table.find(hashes[look])
            hit = look[at >= 0]
            at = at[at >= 0]
            where[hit], lengths[hit] = base + table.offsets[at], table.offsets[at + 1] - table.offsets[at]
            open_[hit] = False
            pools.append(table.ids)
            base += len(table.ids)
        unseen = np.flatnonzero(open_)
        if len(unseen):
            fresh, first, back = np.unique(hashes[unseen], return_index=True, return_inverse=True)
            own, m = self._new([raw[starts[i] : stops[i]].tobytes() for i in unseen[first].tolist()])
            begin = np.cumsum(m) - m
            where[unseen], lengths[unseen] = base + begin[back], m[back]
            pools.append(own)
            base += len(own)
            if len(self.known) + len(self.recent) < self.remember:
                self.recent.add(fresh, m, own)
                if len(self.recent) > self.fresh:
                    r = self.recent
                    order = np.argsort(r.entry)
                    self.known.add(r.hashes[order], np.diff(r.offsets), r.ids)
                    self.recent = Parts()
        long = np.flatnonzero(~usual)
        if len(long):
            each = [self._whole(raw[starts[i] : stops[i]].tobytes().decode()) for i in long.tolist()]
            m = np.array([len(x) for x in each])
            where[long], lengths[long] = base + np.cumsum(m) - m, m
            pools += each
        total = int(lengths.sum())
        ends = np.cumsum(lengths)
        every = np.concatenate(pools)
        ids = every[np.repeat(where - (ends - lengths), lengths) + np.arange(total)]
        return ids, np.append(0, ends)[np.searchsorted(starts, offsets)] if n else np.zeros(1, np.int64)


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    r = ranks.astype("<u4")
    code = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    quads = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    quads[: len(r)] = code
    q = quads.reshape(-1, 4)
    return (q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    lengths = _LENGTHS[control].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < lengths[:, None]] = data
    return out.reshape(-1).view("<u4")


def shard_bytes(doc_ids: list[int | None], ids: list[np.ndarray], rank_of: np.ndarray) -> bytes:
    n = np.array([len(x) for x in ids], "<u8")
    control, data = pack(rank_of[np.concatenate(ids)])
    head = b"SKT1" + np.array([len(ids), n.sum()], "<u8").tobytes()
    own = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids)
    return head + own + n.tobytes() + control + data


def read_shard(blob: bytes, id_of: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, ids per document, all ids)."""
    if blob[:4] != b"SKT1":
        raise ValueError("no token shard")
    docs, total = (int(x) for x in np.frombuffer(blob, "<u8", 2, 4))
    at = 20
    own = np.frombuffer(blob, "<i8", docs, at).tolist()
    null = np.frombuffer(blob, np.uint8, docs, at + 8 * docs)
    n = np.frombuffer(blob, "<u8", docs, at + 9 * docs).astype(np.int64)
    at += 17 * docs
    control = np.frombuffer(blob, np.uint8, -(-total // 4), at)
    data = np.frombuffer(blob, np.uint8, offset=at + len(control))
    return [None if z else d for d, z in zip(own, null, strict=True)], n, id_of[unpack(control, data, total)]


def _put(uri: str, name: str, blob: bytes) -> None:
    store, base = fs.FileSystem.from_uri(uri)
    attempt = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(attempt) as out:
        out.write(blob)
    store.move(attempt, f"{base}/{name}")


def write_corpus(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int, shard_ids: int = 2_000_000) -> None:
    """Encode (doc_id, text) of ``docs`` into shards and ``ranks.tbl`` under ``out_dir`` (a URI all executors reach)."""
    spark = docs.sparkSession

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        part, row = TaskContext.get().partitionId(), 0
        squeeze, seen = _codec(), np.zeros(0, np.int64)
        for batch in batches:
            for piece in slices(batch, "text", 1 << 19):
                found, bounds = encoder.encode(piece.column("text"))
                n = len(bounds) - 1
                ends = bounds[1:] + np.arange(1, n + 1)
                ids = np.full(ends[-1], end_id, np.uint32)
                inside = np.ones(len(ids), bool)
                inside[ends - 1] = False
                ids[inside] = found
                got = np.bincount(ids, minlength=len(seen))
                got[: len(seen)] += seen
                seen = got
                # the bytes of equal weight together compress better
                blobs = [squeeze.compress(x.view(np.uint8).reshape(-1, 4).T.tobytes()).to_pybytes() for x in np.split(ids, ends[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), piece.column("doc_id"), pa.array(np.diff(ends, prepend=0)), pa.array(blobs, pa.binary())],
                    ["part", "row", "doc_id", "n", "ids"],
                )
                row += n
        yield pa.RecordBatch.from_arrays(  # what the task saw of each id, as the last row
            [pa.array([-1], pa.int32()), pa.array([0]), pa.array([None], pa.int64()), pa.array([len(seen)], pa.int64()), pa.array([seen.tobytes()], pa.binary())],
            ["part", "row", "doc_id", "n", "ids"],
        )

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions(spark), F.asc_nulls_first("doc_id"))
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    tokens = materialize(ordered.mapInArrow(trimmed(tokenize), "part int, row long, doc_id long, n long, ids binary"), "tokens")
    del ordered
    free_shuffles(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column("ids").to_pylist():
                got = np.frombuffer(blob, np.int64)
                long, short = (got.copy(), total) if len(got) > len(total) else (total, got)
                long[: len(short)] += short
                total = long
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    counts = tokens.where("part < 0").select("ids").mapInArrow(trimmed(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    id_of = np.array([r.id for r in sorted(counts, key=lambda r: (-r.n, r.id))], "<u4")
    rank_of = np.zeros(int(id_of.max(initial=0)) + 1, np.uint32)
    rank_of[id_of] = np.arange(len(id_of))
    store, base = fs.FileSystem.from_uri(out_dir)
    store.create_dir(base, recursive=True)
    _put(out_dir, "ranks.tbl", b"SKR1" + np.array([len(id_of)], "<u8").tobytes() + id_of.tobytes())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, own, ids, size = -1, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"{part:06d}-{first:012d}"
            _put(out_dir, f"{name}.svb", shard_bytes(own, ids, rank_of))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": [name], "ids": pa.array([size], pa.int64())})

        for batch in batches:
            for p, row, doc, n, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "row", "doc_id", "n", "ids")), strict=True):
                if own and (p != part or row != first + len(own) or size + n > shard_ids):
                    yield flush()
                    own, ids, size = [], [], 0
                if not own:
                    part, first = p, row
                own.append(doc)
                ids.append(_ids(blob, n))
                size += n
        if own:
            yield flush()

    tokens.where("part >= 0").mapInArrow(trimmed(write), "part int, shard string, ids long").write.parquet(f"{out_dir}/manifest")
    discard(tokens)


@functools.cache
def _codec() -> pa.Codec:
    return pa.Codec("zstd", 1)


def _ids(blob: bytes, n: int) -> np.ndarray:
    raw = _codec().decompress(blob, 4 * n)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).reshape(-1).view("<u4")


def read_corpus(spark: SparkSession, out_dir: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids array<int>]) of every document, read from the shards."""
    ranks = spark.read.format("binaryFile").option("pathGlobFilter", "ranks.tbl").load(out_dir).collect()[0].content
    id_of = np.frombuffer(bytes(ranks), "<u4", offset=12)
    names = ["shard", "doc_id", "before", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, blob in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                own, n, ids = read_shard(blob.as_buffer().to_pybytes(), id_of)
                ends = np.cumsum(n)
                raw = np.ascontiguousarray(ids, "<u4")
                crc = [zlib.crc32(raw[b - k : b]) for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
                name = path.rpartition("/")[2].removesuffix(".svb")
                columns = [pa.array([name] * len(own)), pa.array(own, pa.int64()), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "shard string, doc_id long, before long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.svb").load(out_dir).select("path", "content")
    rows = files.mapInArrow(trimmed(read), schema)
    # a shard's place: what earlier ranges hold, then what earlier shards of its range hold
    shards = spark.read.parquet(f"{out_dir}/manifest")
    total, bases = 0, []
    for r in sorted(shards.groupBy("part").agg(F.sum("ids").alias("m")).collect(), key=lambda r: r.part):
        bases.append((r.part, total))
        total += r.m
    base = spark.createDataFrame(bases, "part int, base long")
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.withColumn("earlier", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(base, "part")
    starts = placed.select("shard", (F.col("base") + F.col("earlier")).alias("base"))
    return rows.join(starts, "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), *names[3:])


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = scratch_path(spark, "corpus")
    write_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"), out, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_corpus(spark, out, with_ids=False)
