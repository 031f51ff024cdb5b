"""Language ID, token store, chat collapse, mixing, decontamination, embeddings, language-model scores."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import words
from pyspark.sql import functions as F

from skein.llm import chat_collapse, decontaminate, embedding_dedup, langid, lm_score, mixing, token_store

SF = "/root/testdata/sf0.001"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.op1_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_against_plain_sets(docs, rows, monkeypatch):
    """The bit-sliced filters beside a set of n-grams per language; parts of 2,000 characters make long texts whole again."""
    monkeypatch.setattr(langid, "PART", 2000)
    share = 2e-5
    fold = lambda t: re.sub(r"[\W\d_]+", " ", t or "").lower().strip(" ")

    def grams(t):
        for w in fold(t).split(" "):
            for n in langid.NS:
                x = f" {w} " if w else ""
                yield from (x[i : i + n] for i in range(len(x) - n + 1))

    counts = defaultdict(Counter)
    for r in [*rows, (None, rows[3][1], "en")]:
        if r[2] and r[1] is not None:
            counts[r[2]].update(grams(r[1]))
    members = {lang: {g for g, n in c.items() if n >= share * sum(c.values())} for lang, c in counts.items()}
    order = sorted(counts, key=lambda x: (-sum(counts[x].values()), x))
    filters = langid.fit(docs, train_docs=1 << 20)
    assert filters.langs == order
    compared = 0
    for r in langid.predict(docs.where("doc_id IS NOT NULL"), filters).collect():
        found = Counter(grams(r.text))
        total = sum(found.values())
        if not total:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        true = [sum(n for g, n in found.items() if g in members[lang]) / total for lang in order]
        assert r.score == pytest.approx(max(true), abs=0.02)
        if sorted(true)[-1] - sorted(true)[-2] > 0.02:
            compared += 1
            assert r.lang_pred == order[true.index(max(true))]
    assert compared


def test_marks_are_no_letters(spark):
    df = spark.createDataFrame([(1, "abc abc", "en"), (2, "\u0301", None), (3, "e\u0301", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, langid.fit(df)).collect()}
    assert got == {1: "en", 2: "und", 3: "en"}


def test_language_cases(docs, empty):
    filters = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, filters).collect()}
    assert got[100].lang_pred == got[101].lang_pred == got[109].lang_pred == "und" and got[100].score == 0
    assert got[110].lang_pred in ("en", "de") and "tk" in langid.predict(docs, filters).columns
    none = langid.fit(empty)
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"} and langid.predict(empty, filters).count() == 0


def test_filters_answer_all_languages():
    h = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64)
    f = langid.Filters(["a", "b"], np.zeros((1 << 14, 1), np.uint8), np.zeros(2), 3)
    for i, part in enumerate((h[:600], h[400:])):
        for slot in f.slots_of(part):
            f.masks[slot, 0] |= np.uint8(1 << i)
    masks = f.languages_of(h)[:, 0]
    assert (masks[:600] & 1).all() and (masks[400:] & 2).all() and (masks[400:600] == 3).all()



def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_varbytes():
    values = np.array([0, 1, 255, 256, 65535, 65536, 1 << 24, 2**32 - 1, 7], np.uint32)
    for n in range(len(values) + 1):
        control, data = token_store.pack(values[:n])
        assert (token_store.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == values[:n]).all()


def test_encoder_is_the_library():
    rng = random.Random(3)
    letters = " \n\t  ''sdtmlrve_-.,!?0123abXYéßñ²³¼×\xa0\x85\x1c€—’　中文٣🙂<|endoftext|>"
    tame = letters.replace("<|endoftext|>", "<|,.  ÷\n")
    texts = ["".join(rng.choice(tame) for _ in range(rng.randint(0, 50))) for _ in range(6000)]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(1000)] + ["<|endoftext|> a", "", "ab " * 60_000]
    for remember, fresh in ((50, 10), (10_000, 100), (1 << 20, 1 << 16)):
        e = token_store.Encoder(tokenizer_path(), remember, fresh)
        for at in range(0, len(texts), 500):
            part = texts[at : at + 500]
            ids, bounds = e.encode(pa.array(part))
            for i, t in enumerate(part):
                assert ids[bounds[i] : bounds[i + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_token_round_trip(spark, docs, empty, rows, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    for name, table, plain in (("full", docs, [(None, rows[3][1]), *sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0], r[1] or ""))]), ("none", empty, [])):
        out = f"file://{tmp_path}/{name}"
        token_store.write_corpus(table, out, tokenizer_path(), 2, shard_ids=3000)
        got = sorted(token_store.read_corpus(spark, out).collect(), key=lambda r: r.start)
        start = 0
        assert len(got) == len(plain)
        for r, (doc, text) in zip(got, plain, strict=True):
            ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
            assert (r.doc_id, r.start, r.n_tokens, r.ids) == (doc, start, len(ids), ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            start += len(ids)


def test_chats(spark):
    rng = random.Random(8)
    logs, rows = {}, []
    for c in range(40):
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "yes", "no"])) for _ in range(rng.randint(1, 5))]
        logs[c] = turns if c < 20 else logs[c - 20][: rng.randint(1, 5)]
        if c % 10 == 3:
            logs[c] = [("user", "hi")] * rng.randint(1, 3)
        rows += [(c, i, r, t, "x") for i, (r, t) in enumerate(logs[c])]
    rows += [(None, 0, "user", "hi", "x"), (90, None, "user", "z", "x"), (90, 0, "user", "y", "x")]
    logs[90] = [("user", "z"), ("user", "y")]
    # null turns come before turns below every chunk's first
    rows += [(91, None, "user", "first", "x"), (92, None, "user", "first", "x"), (92, -5000, "user", "then", "x"), (92, 9000, "user", "last", "x")]
    logs[91], logs[92] = [("user", "first")], [("user", "first"), ("user", "then"), ("user", "last")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")
    kept = chat_collapse.maximal(df)
    got = {(r.conv_id, r.n_turns, r.rendered) for r in chat_collapse.render(df, kept).collect()}
    want = set()
    for c, log in logs.items():
        longer = any(len(o) > len(log) and o[: len(log)] == log for o in logs.values())
        if not longer and c == min(k for k, o in logs.items() if o == log):
            want.add((c, len(log), "".join(f"<|{r or ''}|>\n{t or ''}\n" for r, t in log)))
    assert got == want
    assert chat_collapse.render(df.limit(0), chat_collapse.maximal(df.limit(0))).count() == 0


def test_quotas():
    assert mixing.sainte_lague([53, 24, 23], 7, [99] * 3) == [3, 2, 2]
    assert mixing.sainte_lague([1, 1], 4, [1, 99]) == [1, 3] and mixing.sainte_lague([0, 0], 4, [9, 9]) == [0, 0]
    slow = lambda claims, seats: Counter(i for _, i in sorted(((c / (2 * k + 1), -i), i) for i, c in enumerate(claims) for k in range(seats))[-seats:])
    claims = [101.0, 7.5, 33.0, 250.0]
    assert mixing.sainte_lague(claims, 400, [10**6] * 4) == [slow(claims, 400)[i] for i in range(4)]
    targets = mixing.capped_targets([100, 10, 10, 0], [3, 1, 2, 3], 1.5, 2)
    assert sum(targets) == pytest.approx(180) and targets[1:] == [20, 20, 0]


def test_mixing(docs, empty, rows):
    got = mixing.mix(docs).collect()
    everything = [*rows, (None, rows[3][1], "en", "hot")]
    sizes = defaultdict(int)
    for r in everything:
        sizes[r[3]] += len(words(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, mixing.capped_targets([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2), strict=True))
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(everything) and all(abs(taken[s] - targets[s]) <= 4 for s in names)
    assert sorted(map(repr, mixing.mix(docs).collect())) == sorted(map(repr, got))
    assert mixing.mix(empty).count() == 0
    clash = ("size", "full", "cuts", "row", "piece", "d", "k", "_id", "copy", "copies")
    named = docs.select("*", *(F.lit(c).alias(c) for c in clash))
    emitted = mixing.emit(named, mixing.mix(named))
    assert emitted.columns == named.columns
    given, wanted = Counter(), Counter()
    for r in emitted.collect():
        given[r.doc_id, r.source] += len(words(r.text))
    for r in got:
        wanted[r.doc_id, r.source] += r.taken
    assert +given == +wanted


def brute_mix(rows, weights, share, cap):
    """Targets and quotas by raising all shares together, word by word sources in the order of highest quotients."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict.fromkeys(names, 0.0)
    stopped = {s for s in names if not sizes[s]}
    for _ in names:
        rest = share * sum(sizes.values()) - sum(target[s] for s in stopped)
        weight = {s: weights[names.index(s) % len(weights)] for s in names if s not in stopped}
        for s in weight:
            target[s] = rest * weight[s] / sum(weight.values())
        new = {s for s in weight if target[s] > cap * sizes[s]}
        for s in new:
            target[s] = float(cap * sizes[s])
        if not new:
            break
        stopped |= new
    got = dict.fromkeys(names, 0)
    for _ in range(round(sum(target.values()))):
        s = max((s for s in names if target[s] and got[s] < cap * sizes[s]), key=lambda s: (target[s] / (2 * got[s] + 1), -names.index(s)))
        got[s] += 1
    return sizes, target, got


@pytest.mark.parametrize("shard", [250_000, 40])
def test_mixing_repeated_rows(spark, monkeypatch, shard):
    """Equal rows by the dozen; quotas against a word-by-word count, with many shards and a tree of them, and parts of a hot row."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", shard)
    monkeypatch.setattr(mixing, "FAN", 4)
    monkeypatch.setattr(mixing, "COPIES", 16)
    rows = [(1, "a b c d e f g", "x")] * 60 + [(2, "a b c", "x")] * 40 + [(3, "q r s t", "y"), (4, None, "y"), (None, "a b", None), (None, "a b", None)]
    rows += [(10 + i, "w " * (i % 17), "y") for i in range(80)] + [(200, "one", "z"), (201, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    sizes, target, quota = brute_mix(rows, (3, 1, 2), 1.5, 2)
    mixed = mixing.mix(df)
    got = mixed.collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((d, s, len((t or "").split())) for d, t, s in rows)
    taken = Counter()
    for r in got:
        assert (r.source_size, r.target) == (sizes[r.source], pytest.approx(target[r.source])) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert +taken == Counter({s: n for s, n in quota.items() if n})
    given = Counter()
    for r in mixing.emit(df, mixed).collect():
        given[r.doc_id, r.source] += len(words(r.text))
    wanted = Counter()
    for r in got:
        wanted[r.doc_id, r.source] += r.taken
    assert +given == +wanted


def brute_overlap(a, b):
    """Most equal words on one qualifying diagonal of document words a and item words b."""
    need, span = (11, 13) if len(b) >= 13 else (len(b), len(b))
    best = 0
    for shift in range(-len(b), len(a)):
        same = [j for j in range(len(b)) if 0 <= j + shift < len(a) and a[j + shift] == b[j]]
        if len(same) >= need > 4 and any(same[i + need - 1] - same[i] < span for i in range(len(same) - need + 1)):
            best = max(best, len(same))
    return best


@pytest.mark.parametrize("block_words", [1_000_000, 30])
def test_contamination(spark, block_words):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["THE", "the"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 12, 13, 20, 40])))) for i in range(12)] + [(50, None), (51, ""), (None, "w1 " * 20)]
    docs = []
    for i in range(80):
        w = [rng.choice(vocabulary) for _ in range(60)]
        if i % 2:
            own = (items[i % 12][1]).split()
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = "changed"
            own = own[rng.randint(0, 3) :]
            w[10:10] = own
        docs.append((i, " ".join(w)))
    docs += [(200, None), (201, ""), (None, items[10][1]), docs[1]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.overlap) for r in decontaminate.overlaps(df, bench, block_words).collect()}
    want = {(d, i, n) for d, t in docs for i, b in items if i is not None and (n := brute_overlap(words(t, True), words(b, True)))}
    assert got == want and len({d for d, *_ in want}) > 10
    bad = {d for d, *_ in want}
    assert Counter(r.doc_id for r in decontaminate.clean(df, bench, block_words).collect()) == Counter(d for d, _ in docs if d not in bad)
    assert decontaminate.verdicts(df, bench.limit(0)).where("contaminated").count() == 0 and decontaminate.verdicts(df.limit(0), bench).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(6)
    rows, centres = [], rng.standard_normal((12, 16))
    for i in range(300):
        noise = rng.standard_normal(16) * rng.choice([0.02, 0.1, 1.0])
        rows.append((i, (centres[i % 12] + noise).astype(np.float32).tolist(), int(i % 3)))
    rows += [(400, rows[5][1], rows[5][2]), (401, rows[5][1], rows[5][2]), (402, None, 1), (403, [0.0] * 16, 1), (404, [None] * 16, 1), (405, [float("nan")] * 16, 1), (406, rows[5][1], None), (407, [1.0, 2.0], 1), (408, [], 1), (None, rows[5][1], 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, links string")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df).collect()}
    good = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            good[i] = (label, x / math.sqrt((x * x).sum()))
    links = {i: [j for j, (m, y) in good.items() if j != i and m == label and len(y) == len(x) and x @ y >= 0.98] for i, (label, x) in good.items()}
    comp = {i: i for i, *_ in rows if i is not None}
    for _ in range(40):
        for i, near in links.items():
            for j in near:
                comp[i] = comp[j] = min(comp[i], comp[j])
    want = {(i, len(links.get(i, [])), comp[i], comp[i] == i) for i in comp} | {(None, 0, None, True)}
    assert got == want and embedding_dedup.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("piece", [3 << 20, 600])
def test_scores(docs, empty, rows, monkeypatch, piece):
    """Against plain counts of everything; with small pieces every document is in another one."""
    monkeypatch.setattr(lm_score, "PIECE_BYTES", piece)
    taught = ~lm_score.held_out()
    got = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm_score.score(docs, taught).collect())
    everything = [*[(r[0], r[1]) for r in rows], (None, rows[3][1])]
    texts = [(d, [*words(t, True), "END"]) for d, t in everything]
    training = [w for d, w in texts if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    c = Counter(x for w in training for x in w)
    n, v = sum(c.values()), len(c)
    uni = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    pairs = Counter((a, b) for w in training for a, b in zip(["<s>", *w], w, strict=False))
    triples = Counter((a, b, x) for w in training for a, b, x in zip(["<s>", *w], w, w[1:], strict=False))
    after = {**c, "<s>": len(training)}
    k1, k2 = lm_score.K1, lm_score.K2
    two = lambda a, w: (pairs[a, w] + k1 * uni(w)) / (after.get(a, 0) + k1)
    three = lambda a, b, w: (triples[a, b, w] + k2 * two(b, w)) / (pairs[a, b] + k2)
    want = Counter()
    for d, w in texts:
        x = ["<s>", *w]
        score = math.log10(two("<s>", w[0])) + sum(math.log10(three(*x[i - 2 : i + 1])) for i in range(2, len(x)))
        want[d, len(w), sum(t in c for t in w), n, round(sum(math.log10(uni(t)) for t in w), 6), round(score, 6)] += 1
    assert {k[:4] for k in got} == {k[:4] for k in want}
    for a, b in zip(sorted(got.elements(), key=repr), sorted(want.elements(), key=repr), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-6)
    unknown = 0.5 / (n + 0.5 * (v + 1))
    for a, b in list(pairs)[:20]:  # every state is a distribution over known words and one unknown
        if b != "END":
            assert sum(two(b, t) for t in c) + k1 * unknown / (after[b] + k1) == pytest.approx(1)
            assert sum(three(a, b, t) for t in c) + k2 * k1 * unknown / (after[b] + k1) / (pairs[a, b] + k2) == pytest.approx(1)
    assert {(r.base_score, r.score, r.n_known) for r in lm_score.score(docs, F.lit(False)).collect()} == {(0.0, 0.0, 0)}
    assert lm_score.score(empty, taught).count() == 0


def test_keys_of_many_buckets():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)
    for bits in (0, 7, 16, 24):
        split = lm_score._split(keys, bits)
        bucket = split >> np.uint64(min(lm_score.KEY_BITS, 64 - bits))
        assert int(bucket.max()) < max(1, 1 << bits) and len(np.unique(split)) == 1000
        assert len({(int(b), int(k) & ((1 << 48) - 1)) for b, k in zip(bucket, split, strict=True)}) == 1000


def test_pipeline_stages(spark, docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    frame = docs.select("*", F.length("text").cast("long").alias("n_chars"), *(F.lit(1).alias(c) for c in ("_key", "row", "d", "k", "component_id", "lang_score", "size")))
    bench = spark.createDataFrame([(0, docs.where("doc_id = 5").first().text)], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = frame
    for name, stage in pipeline.STAGES:
        before = Counter(r.doc_id for r in seen.select("doc_id").collect())
        out = stage(spark, seen, str(tmp_path))
        after = Counter(r.doc_id for r in out.select("doc_id").collect())
        if name == "language_id":
            assert not {100, 101, 102, 109} & set(after) and 1 in after
        elif name == "near_dedup":
            assert [i for i in range(60, 90) if i in after] == [60, 61] and after[0] == 1 and {1, 2, 3} <= set(after)
        elif name == "decontaminate":
            assert set(before) - set(after) == {5}
        elif name == "mix_sources":
            assert max(after.values()) <= 3
        else:
            assert after == before and set(out.columns) >= {"doc_id", "start", "n_tokens"}
        if name != "token_store":
            assert out.columns == frame.columns
        seen = pipeline.materialize(out, name)
