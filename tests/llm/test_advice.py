"""What a review found to do less than the whole job."""

from collections import Counter

import numpy as np

from skein.llm import embedding_dedup, mixing, near_dedup


def test_small_sources_of_large_corpora(spark):
    assert mixing.sainte_lague([7.5e9, 30.0, 3.0], 7_500_000_033, [10**11] * 3) == [7_500_000_000, 30, 3]
    rows = [(i, "w " * 8000, "hot") for i in range(300)] + [(1000 + i, "a b c d e f g", f"small{i % 3}") for i in range(12)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(target) == 4 and all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_near_copies_among_documents_of_a_template(spark):
    rng = np.random.default_rng(4)
    template, rows = [f"t{k}" for k in range(84)], []
    for i in range(200):
        # two in four share 5 of their 16 own words: 89 of 111 words, unrelated documents 84 of 116
        shared = [f"p{i // 2}x{k}" for k in range(5 if i % 4 < 2 else 0)]
        own = [*template, *shared, *(f"d{i}x{k}" for k in range(16 - len(shared)))]
        rows.append((i, " ".join(rng.permutation(own))))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80, n=1, small=16).collect()}
    assert got == {i: i - 1 if i % 4 == 1 else i for i in range(200)}


def cone(n):
    """Vectors of one label about one direction, and twins of a tenth of them at cosine 0.982."""
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.sqrt((v * v).sum(1, keepdims=True))
    x = unit(rng.standard_normal((1, 64)) * 3 + rng.standard_normal((n, 64)))
    y = x[: n // 10]
    side = rng.standard_normal(y.shape)
    side = unit(side - (side * y).sum(1, keepdims=True) * y)
    return np.concatenate([x, 0.982 * y + np.sqrt(1 - 0.982**2) * side])


def test_pairs_in_a_cone_of_vectors(spark):
    n = 4000
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(cone(n))], "vec_id long, embedding array<double>, label int")
    for exact in (16_384, 500):
        got = {r.vec_id: r.component_id for r in embedding_dedup.near_vectors(df, exact=exact, window=4).collect()}
        assert [i for i in range(n // 10) if got[n + i] != got[i]] == []
