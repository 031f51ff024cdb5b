"""Line, substring and near dedup against brute force, with every awkward case in one table."""


from collections import Counter

import numpy as np
import pytest
from llm_fixtures import LOWER, SEP, words
from pyspark.sql import functions as F

from skein.llm import line_dedup, near_dedup, substring_dedup
from skein.llm.components import connected_components


def test_lines(docs, empty, rows):
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.apply(docs, line_dedup.keep_bitmaps(docs)).collect())
    key = lambda x: x.strip(SEP).encode().translate(LOWER).decode()
    first = {}
    for doc, text, *_ in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 10:
                first[key(x)] = min(first.get(key(x), doc), doc)
    want = Counter()
    for doc, text, *_ in [*rows, (None, rows[3][1])]:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or not first.get(key(x), doc) < doc]
        want[doc, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    assert got == want and any(k[2] for k in want)
    assert line_dedup.apply(empty, line_dedup.keep_bitmaps(empty)).count() == 0
    named = docs.select("*", *(F.lit(1).alias(c) for c in ("dropped", "keep", "dense", "row", "_n")))
    assert line_dedup.apply(named, line_dedup.keep_bitmaps(named)).columns == [*named.columns, "kept_text", "n_lines", "n_dropped"]
    for r in line_dedup.keep_bitmaps(docs).collect():  # words of which all lines stay are absent
        assert all(w.bits != -1 for w in r.keep) and r.n_dropped == sum(64 - bin(w.bits & (2**64 - 1)).count("1") for w in r.keep)


def test_heavy_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HEAVY_PARTS", 1 << 30)
    df = spark.createDataFrame([(i, f"the same line again\nline number {i} alone") for i in range(1500)], "doc_id long, text string")
    bitmaps = line_dedup.keep_bitmaps(df)
    assert bitmaps.count() == 1499 and bitmaps.agg({"doc_id": "min"}).first()[0] == 1


@pytest.mark.parametrize("hot", [50_000, 1])
def test_substrings(docs, empty, rows, hot):
    window = 35
    everything = [*rows, (None, rows[3][1])]
    seen = Counter()
    for _, text, *_ in everything:
        w = words(text)
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    want = Counter()
    for doc, text, *_ in everything:
        w = words(text)
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        want[doc, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()] += 1
    got = Counter(tuple(r) for r in substring_dedup.remove_spans(docs, substring_dedup.duplicate_spans(docs, hot=hot)).collect())
    assert got == want
    assert substring_dedup.remove_spans(empty, substring_dedup.duplicate_spans(empty)).count() == 0


def test_factors(docs, rows):
    """Every factor's words stand at its reference, which is another place, and none could be longer to the right of its anchor's windows."""
    texts = {(d, bytes(t or "", "utf8")): words(t) for d, t, *_ in rows}
    by_id = {}
    for (d, _), w in texts.items():
        by_id.setdefault(d, []).append(w)
    for hot in (50_000, 1):
        found = substring_dedup.factors(docs.where("doc_id IS NOT NULL"), hot=hot).collect()
        assert found
        for r in found:
            assert r.e - r.s >= 35
            assert any(w[r.s : r.e] == v[r.ref_pos : r.ref_pos + r.e - r.s] for w in by_id[r.doc_id] for v in by_id[r.ref_doc])
            assert (r.doc_id, r.s) != (r.ref_doc, r.ref_pos) or sum(d == r.doc_id for d, *_ in rows) > 1


def test_blocks_take_the_longest_match():
    rng = np.random.default_rng(2)
    n, width = 300, 6
    g = rng.integers(0, 20, n)
    grid = rng.integers(0, 3, (n, width))
    lead, sizes = rng.integers(0, 3, n), rng.integers(1, 4, n)
    flat = np.concatenate([grid[i, a : a + k] for i, (a, k) in enumerate(zip(lead, sizes, strict=True))])
    block = substring_dedup.ReferenceBlock(g, lead, sizes, flat.astype(np.int64), width)

    def longest(i, c):
        best = 0
        for j in range(n):
            k = 0
            while j != i and g[j] == g[i] and c + k < lead[i] + sizes[i] and lead[j] <= c + k < lead[j] + sizes[j] and grid[i, c + k] == grid[j, c + k]:
                k += 1
            best = max(best, k)
        return best

    want = []
    for i in range(n):
        c = lead[i]
        while c < lead[i] + sizes[i]:
            k = longest(i, c)
            if k:
                want.append((i, c, k))
            c += max(1, k)
    row, at, length, ref = block.factors()
    assert sorted(zip(row.tolist(), at.tolist(), length.tolist(), strict=True)) == sorted(want)
    for i, c, k, j in zip(row, at, length, ref, strict=True):
        assert i != j and g[i] == g[j] and (grid[i, c : c + k] == grid[j, c : c + k]).all()


def test_anchors_stay_whole(spark):
    """Some anchors hot, some not, and every join split as far as adaptive execution can: no block may be divided over tasks."""
    rng = np.random.default_rng(8)
    prose = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    shared, pairs = prose(60), [prose(45) for _ in range(400)]
    rows = [(i, " ".join([*prose(20), *(shared if i % 2 else pairs[i // 2 % 400]), *prose(20), *pairs[i % 400]])) for i in range(3200)]
    window, seen = 35, Counter()
    split = [(i, t.split()) for i, t in rows]
    for _, w in split:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    want = {}
    for doc, w in split:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        want[doc] = int(gone.sum())
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: r.n_removed for r in substring_dedup.remove_spans(docs, substring_dedup.duplicate_spans(docs, hot=1000)).collect()}
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert got == want


def shingles(text, n=5):
    w = words(text, fold=True)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    sets = [(d, shingles(t)) for d, t, *_ in rows]
    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1 :]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(d, len(s), find(d), find(d) == d) for d, s in sets]


@pytest.mark.parametrize("small", [256, 4])
def test_near_copies(docs, empty, rows, small):
    """With small = 4 the group of near copies goes through dense nodes."""
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, small=small, depth=12 if small == 256 else 3).collect())
    want = Counter(brute_components(rows, 85))
    want[None, len(shingles(rows[3][1])), None, True] += 1
    assert got == want
    assert near_dedup.near_duplicates(empty).count() == 0


def test_node_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    sets = []
    for _ in range(30):
        s = base.copy()
        k = rng.integers(0, 60)
        s[:k] = rng.integers(0, 1 << 60, k)
        sets.append(np.unique(s))
    links = near_dedup.node_links(sets, 85)
    linked = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))
    assert all(linked(i, j) for i, j in links)
    groups = brute_groups(30, [(i, j) for i in range(30) for j in range(i) if linked(i, j)])
    assert groups == brute_groups(30, links)


def brute_groups(n, links):
    group = list(range(n))
    for _ in range(n):
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
    return group


def test_components(spark):
    links = [(5, 6), (6, 7), (1, 9), (9, 1), (3, 3), (None, 2), *((100, 100 + i) for i in range(1, 50)), *((i, i + 1) for i in range(200, 260))]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {5: 5, 6: 5, 7: 5, 1: 1, 9: 1, **{100 + i: 100 for i in range(50)}, **{i: 200 for i in range(200, 261)}}
    assert got == want


def test_word_hashes():
    import pyarrow as pa

    from skein.llm import _words

    texts = [None, "", " ", "a", "A b\tc\x0bd\n", "é" * 3, "x" * 100 + " y", "ab ba"]
    seen = {}
    for fold in (False, True):
        w = _words.word_hashes(pa.array(texts), fold)
        at = 0
        for i, t in enumerate(texts):
            own = words(t, fold)
            assert w.bounds[i + 1] - w.bounds[i] == len(own)
            for x in own:
                assert seen.setdefault(x, int(w.hashes[at])) == int(w.hashes[at])
                at += 1
    assert len(set(seen.values())) == len(seen)
