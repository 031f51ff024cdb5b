"""Vectorised words and word hashes of a batch of texts, straight from Arrow's buffers.

A word is a maximal run of bytes other than space and \\x09-\\x0D. Its hash is
64 bits of a polynomial over seeded byte values, so a batch costs a fixed
number of numpy passes and no Python object per word. The text is walked in
pieces of about ``PIECE`` bytes that end between words, so one very long
document needs no more memory than its words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]
_BASE = int(_rng.integers(1 << 61, 1 << 62)) * 2 + 1
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_UP: np.ndarray | None = None
_DOWN: np.ndarray | None = None


def _powers() -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if _UP is None:
        up = np.full(PIECE, _BASE, np.uint64)
        down = np.full(PIECE, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _UP, _DOWN = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _UP, _DOWN


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finish, so that every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


@dataclass
class Words:
    """Words of some texts: hash, and text number ``t``'s words are ``bounds[t]:bounds[t + 1]``."""

    hashes: np.ndarray
    bounds: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def word_hashes(texts: pa.Array, fold: bool) -> Words:
    """``fold``: A-Z count as a-z."""
    raw, offsets = text_bytes(texts)
    table, (up, down) = (_FOLD if fold else _BYTE), _powers()
    hashes, starts_at = [], []
    cuts = np.zeros(len(raw) + 1, bool)
    cuts[offsets] = True
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        if end < len(raw):  # step back to a place between words; a single word longer than the piece is cut by the fallback
            back = raw[at:end]
            free = np.flatnonzero(_SEP[back] | cuts[at:end])
            if len(free) and free[-1] > 0:
                end = at + int(free[-1])
            else:
                h, s, end = _long_word(raw, cuts, at, table)
                hashes.append(h)
                starts_at.append(s)
                at = end
                continue
        piece = raw[at:end]
        word = ~_SEP[piece]
        brk = cuts[at:end]
        prev = np.empty(len(word), bool)
        prev[0], prev[1:] = False, word[:-1]
        first = word & (~prev | brk)
        starts = np.flatnonzero(first)
        if len(starts):
            last = np.empty(len(word), bool)
            last[-1] = True
            last[:-1] = ~word[1:] | brk[1:]
            stops = np.flatnonzero(word & last) + 1
            sums = np.empty(len(piece) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(table[piece] * up[: len(piece)], out=sums[1:])
            hashes.append(mix64((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64)))
            starts_at.append(starts + at)
        at = end
    got = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    where = np.concatenate(starts_at) if starts_at else np.zeros(0, np.int64)
    return Words(got, np.searchsorted(where, offsets))


def span_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of ascending byte spans, each of at most a piece."""
    up, down = _powers()
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        base = starts[a]
        b = int(np.searchsorted(stops, base + PIECE, side="right"))
        piece = raw[base : stops[b - 1]]
        sums = np.empty(len(piece) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[piece] * up[: len(piece)], out=sums[1:])
        s, e = starts[a:b] - base, stops[a:b] - base
        out[a:b] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        a = b
    return out


def _long_word(raw: np.ndarray, cuts: np.ndarray, at: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """One word of more than a piece of bytes, by the same polynomial, piece by piece."""
    if _SEP[raw[at]]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), at + 1
    up, _ = _powers()
    total, scale, end = 0, 1, at
    while end < len(raw):
        piece = raw[end : end + PIECE]
        stop = np.flatnonzero(_SEP[piece] | (cuts[end : end + len(piece)] & (np.arange(end, end + len(piece)) > at)))
        n = int(stop[0]) if len(stop) else len(piece)
        total = (total + int((table[piece[:n]] * up[:n]).sum(dtype=np.uint64)) * scale) % (1 << 64)
        scale = scale * pow(_BASE, n, 1 << 64) % (1 << 64)
        end += n
        if len(stop):
            break
    h = np.array([(total + end - at) % (1 << 64)], np.uint64)
    return mix64(h), np.array([at]), end


def grams(words: Words, n: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of every run of n words inside one text; place: index of its first word.

    With ``weights`` (n odd multipliers, 0 for a place that doesn't count) the run is hashed by those.
    """
    total = len(words.hashes)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    by = gram_weights(n) if weights is None else weights
    h = np.zeros(total - n + 1, np.uint64)
    for j in range(n):
        if by[j]:
            h += words.hashes[j : total - n + 1 + j] * by[j]
    inside = np.ones(total + 1, bool)
    for b in words.bounds[1:-1]:  # a run may not cross from one text into the next
        inside[max(0, b - n + 1) : b] = False
    place = np.flatnonzero(inside[: total - n + 1])
    return mix64(h[place]), place


def gram_weights(n: int) -> np.ndarray:
    return np.random.default_rng(977 + n).integers(1 << 61, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``most`` bytes of text."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


class Lookup:
    """Places of 64-bit hashes in a sorted table, by their leading bits: a constant number of numpy passes, whatever the table."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.bits = max(1, int(len(table)).bit_length())
        lead = (table >> np.uint64(64 - self.bits)).astype(np.int64)
        self.starts = np.searchsorted(lead, np.arange((1 << self.bits) + 1))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        lead = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.starts[lead], self.starts[lead + 1]
        live = np.flatnonzero(at < end)
        at, end = at[live], end[live]
        while len(live):
            same = self.table[at] == h[live]
            out[live[same]] = at[same]
            at = at + 1
            more = ~same & (at < end)
            live, at, end = live[more], at[more], end[more]
        return out
