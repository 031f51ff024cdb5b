"""The whole pipeline against a brute-force version in plain Python, row for row."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from llm_fixtures import prose, words
from test_others import brute_mix, brute_overlap, tokenizer_path


def corpus():
    """(doc_id, text, lang, source): two taught languages and a foreign one, near copies, benchmark passages, an equal row, a null id."""
    rng = random.Random(21)
    make = lambda letters: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(250)]
    vocabulary = {"en": make("abcdefghij"), "de": make("klmnopqrstß"), None: make("uvwxyz")}
    source = lambda i: "hot" if i % 3 else ("s1", "s2", None, "s3")[i % 4]
    rows = []
    for i in range(100):
        lang = ("en", "de")[i % 2]
        rows.append((i, prose(rng, rng.randint(3, 90), vocabulary[lang]), lang if i % 5 else None, source(i)))
    for b in range(12):  # copies with up to four changed words
        base = prose(rng, 100, vocabulary["en"]).split(" ")
        for c in range(5):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(100)] = rng.choice(vocabulary["en"])
            rows.append((200 + b + 20 * c, " ".join(copy).upper() if c == 1 else " ".join(copy), "en", source(b + c)))
    items = [(i, prose(rng, 25, vocabulary["de"])) for i in range(5)]
    for i in range(30):
        passage = items[i % 5][1].split(" ")
        for _ in range(i % 4):
            passage[rng.randrange(25)] = "krkr"
        rows.append((400 + i, " ".join([prose(rng, 30, vocabulary["de"]), *passage, prose(rng, 20, vocabulary["de"])]), "de", source(i)))
    rows += [(500 + i, prose(rng, 40, vocabulary[None]), None, "hot") for i in range(10)]
    rows += [(600, None, "en", "hot"), (601, "", "de", None), (602, "12 34 !?", "en", "s1"), (603, prose(rng, 5000, vocabulary["de"]), "de", "s2")]
    rows += [rows[7], (None, rows[9][1], "de", "hot")]
    return rows, items


def taught(rows):
    """Per language the set of n-grams above the share, from all labelled texts."""

    def grams(text):
        for w in re.sub(r"[\W\d_]+", " ", text or "").lower().strip(" ").split(" "):
            x = f" {w} " if w else ""
            for n in (2, 3, 4, 5):
                yield from (x[i : i + n] for i in range(len(x) - n + 1))

    counts = defaultdict(Counter)
    for _, text, lang, _ in rows:
        if lang and text is not None:
            counts[lang].update(grams(text))
    members = {lang: {g for g, n in c.items() if n >= 2e-5 * sum(c.values())} for lang, c in counts.items()}

    def score(text):
        found = list(grams(text))
        return max(sum(g in m for g in found) / len(found) for m in members.values()) if found else 0.0

    return score


def without_copies(rows):
    rest = [r for r in rows if r[0] is None]
    own = {r[0]: r for r in rows if r[0] is not None}
    sets = {}
    for i, r in own.items():
        w = words(r[1], True)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    least = {i: i for i in own}
    links = [(a, b) for a in own for b in own if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in own:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    assert len(links) > 20
    return [r for i, r in own.items() if least[i] == i] + rest


def spark_hash(*values):
    """Spark's xxhash64 of (value, bytes) pairs and of text, signed."""
    seed = 42
    for v in values:
        if v is None:
            continue
        raw = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def mixed(rows):
    """Every source's quota of words as one circular run over its documents in hash order."""
    sizes, _, quota = brute_mix([(d, t, s) for d, t, _, s in rows], (3, 1, 2), 1.5, 2)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    out = []
    for sid, name in enumerate(names):
        own = []
        for d, t, _, s in rows:
            if s == name:
                tk, size = spark_hash(t), len(words(t))
                own.append(((spark_hash((8, 4), None if d is None else (d, 8), (tk, 8)), tk), d, t, size))
        own.sort(key=lambda x: x[0])
        n = sizes[name]
        full, extra = divmod(quota[name], n) if n else (0, 0)
        start = spark_hash((9, 4), (sid, 4), (0, 8)) % max(n, 1)
        at = 0
        for _, d, t, size in own:
            parts = [(0, size)] * full
            for lo, hi in ((start, min(start + extra, n)), (0, start + extra - n)):
                parts.append((min(max(lo - at, 0), size), min(max(hi - at, 0), size)))
            for a, b in parts:
                if b > a:
                    out.append((d, t if (a, b) == (0, size) else b" ".join(words(t)[a:b]).decode()))
            at += size
    return out


def test_pipeline_is_the_brute_force(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    score = taught(rows)
    scores = [score(t) for _, t, _, _ in rows]
    assert not any(abs(s - pipeline.LEAST_LANGUAGE_SCORE) < 0.03 for s in scores)
    known = [r for r, s in zip(rows, scores, strict=True) if s >= pipeline.LEAST_LANGUAGE_SCORE]
    single = without_copies(known)
    clean = [r for r in single if not any(brute_overlap(words(r[1], True), words(b, True)) for _, b in items)]
    assert len(rows) > len(known) > len(single) > len(clean) > 60
    library = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for d, t in mixed(clean):
        ids = [*library.encode(t, add_special_tokens=False).ids, pipeline.END_ID]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = sorted(pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
