"""Language ID: language-bitmask n-gram filters.

Per language a Bloom filter holds the character n-grams that make up at least
``share`` of the language's training n-grams, so a filter has at most
1/``share`` members whatever the corpus. The filters are bit-sliced: slot ``s``
of one shared table is a mask whose bit L is slot ``s`` of language L's filter,
so ``hashes`` lookups and an AND return all languages that contain an n-gram at
once. A text's n-grams give a popcount per language; the expected false
positives are taken out of it, ``(count - n * fpr) / (1 - fpr)`` with
``fpr = fill ** hashes``, and the language with the highest corrected count
decides. The score is that count's share of the text's n-grams.

Training reads a bounded sample of rows, as a documented parameter says: of every
language about ``train_docs`` documents, those with the lowest hashes, and of
these the whole texts, as prediction does. ``share`` is part of the model, not of
its data: rarer n-grams are names and loans that tell nothing, and dropping them
keeps the filters as sparse for a sample of long documents as for one of short.

Scale. Training gathers at most languages * train_docs documents and
languages / share n-gram hashes; the table of ``slots`` masks is the only thing
sent to executors (``slots`` * 8 bytes per 64 languages at most). Prediction is
one narrow pass without a shuffle, in numpy, with pieces of bounded size.

Very long texts go through in parts of about ``PART`` characters that end between
words, whose counts add up.

Defined cases. Null text or text without a letter (combining marks alone are
none): ``und``, score 0. No
labelled document at all: ``und`` for everything. Letters but no known n-gram:
the most frequent training language, score 0. Ties go to the language with
more training n-grams, then to the lower code. Rows that repeat are judged
alike; a null doc_id is held in training like any other (its remainder is
null, so it is not held out); extra columns pass through ``predict``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm._store import materialize
from skein.llm._words import mix64, slices
from skein.session import table

NS = (2, 3, 4, 5)
SPACE = 32
_MULT = [np.uint64(x | 1) for x in np.random.default_rng(41).integers(1 << 60, 1 << 63, max(NS), dtype=np.uint64).tolist()]
PART = 1 << 18
_FOLDED: np.ndarray | None = None
_LETTER: np.ndarray | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case letter or mark, a space for whatever is neither; whether it is a letter."""
    global _FOLDED, _LETTER
    if _FOLDED is None:
        out, letter = np.full(0x110000, SPACE, np.uint32), np.zeros(0x110000, bool)
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000:
                continue
            ch = chr(c)
            kind = unicodedata.category(ch)[0]
            if kind in "LM":
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
                letter[c] = kind == "L"
        _FOLDED, _LETTER = out, letter
    return _FOLDED, _LETTER


def parts(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The texts in parts of at most ``PART`` characters, cut between words where there is a space, and the text each part is of."""
    out, own = [], []
    for t, text in enumerate(texts):
        at = 0
        while len(text) - at > PART:
            end = text.rfind(" ", at, at + PART)
            end = end if end > at else at + PART
            out.append(text[at:end])
            own.append(t)
            at = end
        out.append(text[at:])
        own.append(t)
    return out, np.array(own, np.int64)


def ngram_hashes(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, owners, has_letter per text), once for each length of n-grams; words are framed by spaces, a run of non-letters is one."""
    pieces, owners = [], []
    letters = np.zeros(len(texts), bool)
    for t, text in enumerate(texts):
        raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        if not len(raw):
            continue
        folded, letter = _tables()
        c = folded[raw]
        gap = c == SPACE
        keep = ~gap
        letters[t] = letter[raw].any()
        if not letters[t]:
            continue
        keep[1:] |= ~gap[:-1]  # the first of a run of gaps stays
        body = c[keep]
        body = body[:-1] if body[-1] == SPACE else body
        framed = np.concatenate(([SPACE], body, [SPACE])).astype(np.uint64)
        pieces.append(framed)
        owners.append(np.full(len(framed), t, np.int32))
    if not pieces:
        return
    codes, own = np.concatenate(pieces), np.concatenate(owners)
    acc = codes * _MULT[0]
    inner = np.zeros(len(codes), np.int16)  # spaces inside so far
    for n in range(2, max(NS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        acc = acc[:m] + codes[n - 1 :] * _MULT[n - 1]
        if n > 2:  # no space but at the ends
            inner = inner[:m] + (codes[n - 2 : n - 2 + m] == SPACE)
        else:
            inner = inner[:m]
        if n in NS:
            ok = np.flatnonzero((inner == 0) & (own[:m] == own[n - 1 :]))
            yield mix64(acc[ok] + np.uint64(n)), own[ok], letters


@dataclass
class Filters:
    langs: list[str]
    masks: np.ndarray  # slots x words of 64 languages
    fpr: np.ndarray
    hashes: int

    def slots_of(self, h: np.ndarray) -> Iterator[np.ndarray]:
        size = np.uint64(len(self.masks) - 1)
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(self.hashes):
            yield ((h + np.uint64(i) * step) & size).astype(np.int64)

    def languages_of(self, h: np.ndarray) -> np.ndarray:
        """All languages that contain each n-gram, as masks."""
        found = None
        for slot in self.slots_of(h):
            got = self.masks[slot]
            found = got if found is None else found & got
        return found

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        filled, of = parts([t or "" for t in texts])
        n, w = len(texts), len(self.langs)
        total, counts, letters = np.zeros(n), np.zeros((n, w)), np.zeros(n, bool)
        if not w:
            return ["und"] * n, total
        for h, own, has in ngram_hashes(filled):
            letters[of[has]] = True
            own = of[own]
            masks = self.languages_of(h)
            total += np.bincount(own, minlength=n)
            for i in range(w):
                bit = (masks[:, i // 64] >> masks.dtype.type(i % 64)) & masks.dtype.type(1)
                counts[:, i] += np.bincount(own[bit.astype(bool)], minlength=n)
        true = np.clip((counts - total[:, None] * self.fpr) / (1 - self.fpr), 0, None)
        best = true.argmax(1)
        score = np.clip(np.divide(true[np.arange(n), best], total, out=np.zeros(n), where=total > 0), 0, 1)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def fit(
    labelled: DataFrame, train_docs: int = 2000, share: float = 2e-5, slots: int = 1 << 21, hashes: int = 3
) -> Filters:
    """Filters from rows (doc_id, text, lang); rows without text or lang teach nothing."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(
        "lang", F.xxhash64("doc_id", "text").alias("r"), "text"
    )
    # a hash below the language's limit: of n rows a share of train_docs / n, chosen by what they hold
    # (one row a language, as many as the masks have bits)
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    limits = [(r.lang, int(min(1.0, train_docs / r.n) * (1 << 32))) for r in sizes]
    of = F.broadcast(rows.sparkSession.createDataFrame(limits, "of string, limit long"))
    sample = rows.join(of, F.col("lang") == F.col("of")).where(F.shiftrightunsigned("r", 32) < F.col("limit")).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                pieces, _ = parts(part["text"].tolist())
                ends = np.cumsum([len(x) for x in pieces])
                for group in np.split(np.arange(len(pieces)), np.searchsorted(ends, np.arange(1 << 20, ends[-1], 1 << 20))):
                    for h, _, _ in ngram_hashes([pieces[i] for i in group]):
                        got, n = np.unique(h, return_counts=True)
                        yield pd.DataFrame({"lang": lang, "h": got.view(np.int64), "n": n})

    grams = sample.mapInPandas(count, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    grams = materialize(grams, "lang-grams")
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    # at most 1 / share members a language
    members = grams.join(totals, "lang").where(F.col("n") >= F.col("total") * share).select("lang", "h").toPandas()
    by_size = sorted(totals.collect(), key=lambda r: (-r.total, r.lang))
    langs = [r.lang for r in by_size]
    width = len(langs)
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if min(width, 64) <= np.dtype(k).itemsize * 8)
    out = Filters(langs, np.zeros((slots, max(1, -(-width // 64))), kind), np.zeros(width), hashes)
    for i, lang in enumerate(langs):
        h = members.loc[members["lang"] == lang, "h"].to_numpy(np.int64).view(np.uint64)
        filled = np.zeros(slots, bool)
        for slot in out.slots_of(h):
            filled[slot] = True
        out.masks[:, i // 64] |= filled.astype(kind) << kind(i % 64)
        out.fpr[i] = filled.mean() ** hashes
    return out


def predict(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """``docs`` plus lang_pred and score (earlier columns of these names are replaced)."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*own)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 1 << 16):
                langs, scores = filters.judge(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*own, "lang_pred", "score"]
                )

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = fit(docs.where(~held_out()))
    judged = predict(docs.select("doc_id", "text"), filters)
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
