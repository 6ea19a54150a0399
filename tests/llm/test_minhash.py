import numpy as np
import pytest
from test_ngramjoin import corpus

from reelspan.llm.minhash import half_keys, minhash_components, tensor_recall
from reelspan.llm.ngramjoin import jaccard_components


def grams(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)]) if w else frozenset()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [e for k, (e, _) in enumerate(rows) if group[k] == group[i] and e is not None]
        c = (min(ids) if ids else None) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "tile"), [(3, 256), (4, 16)])
def test_equals_brute_force(spark, seed, tile):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, node int, halves string").repartition(3)
    assert sorted(map(tuple, minhash_components(df, tile=tile).collect()), key=str) == brute(rows)


def test_equals_the_exact_join(spark):
    """On the test table, all components of the exact n-gram join at the same size and threshold."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    exact = jaccard_components(docs, size=4, percent=80)
    assert sorted(map(tuple, minhash_components(docs).drop("kept").collect())) == sorted(map(tuple, exact.collect()))


def test_empty_and_long(spark):
    assert minhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join(str(k) for k in range(300_000))
    df = spark.createDataFrame([(2, text), (1, text + " end"), (3, "x" * 3_000_000), (4, None), (5, " ")], "doc_id long, text string")
    got = sorted(map(tuple, minhash_components(df).collect()))
    assert got == [(1, 299_998, 1, True), (2, 299_997, 1, False), (3, 1, 3, True), (4, 0, 4, True), (5, 0, 5, True)]


def test_half_keys_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(150):
        common = rng.integers(0, 1 << 64, 80, dtype=np.uint64)
        a, b = (np.sort(np.concatenate([common, rng.integers(0, 1 << 64, 10, dtype=np.uint64)])) for _ in range(2))
        x, y = half_keys([a, b], 3, 16)
        agree.append((x == y).mean())
    assert abs(np.mean(agree) - 0.8**3) < 0.03
    assert tensor_recall(0.8, 3, 16) > 0.9999 and tensor_recall(0.1, 3, 16) < 0.001
