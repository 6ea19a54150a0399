import math

import numpy as np
from pyspark.sql import Row

from reelspan.llm import mixing, neighbours

DOC = "doc_id long, text string, source string, n_chars long, size string, `key` int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 0, "x", 1) for i, t, s in rows], DOC)


def brute_mix(rows, weights=(1, 2, 3), cap=3):
    import hashlib

    sources = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    size = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in sources}
    w = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    total, capped = sum(size.values()), set()
    while True:
        left = total - sum(cap * size[s] for s in capped)
        free = [s for s in sources if s not in capped]
        target = {s: cap * size[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in sources}
        over = [s for s in free if target[s] > cap * size[s] + 1e-9]
        if not over:
            break
        capped.update(over)
    out = {}
    for s in sources:
        own = sorted((hashlib.md5(f"mix:{i}".encode()).hexdigest(), i, len((t or "").split())) for i, t, x in rows if x == s)
        budget = math.floor(target[s] + 1e-9)
        while any(n for *_, n in own) and budget > 0:
            for _, i, n in own:
                out[i] = out.get(i, 0) + min(n, budget)
                budget -= min(n, budget)
    return target, out


def test_mix_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("w" * rng.integers(1, 40)), [None, "a", "b", "hot", "hot", "ß"][rng.integers(6)]) for i in range(300)]
    rows += [(300, None, "a"), (301, "", None), (302, "x " * 5000, "a"), (303, "one", "small")]
    got = {r.doc_id: r for r in mixing.mix_sources(docs(spark, rows)).collect()}
    target, taken = brute_mix(rows)
    assert len(got) == len(rows)
    for i, _, s in rows:
        assert got[i].target == pytest_approx(target[s])
        assert got[i].taken == taken.get(i, 0)
        assert got[i].taken <= 3 * got[i].size


def pytest_approx(x):
    import pytest

    return pytest.approx(x, rel=1e-12)


def test_mix_edges(spark):
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    r = mixing.mix_sources(docs(spark, [(1, None, None), (1, None, None), (None, "a b", "s")])).collect()
    assert sorted((x.doc_id is None, x.taken) for x in r) == [(False, 0), (False, 0), (True, 2)]


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(400, 16)).astype(np.float32)
    m[50:60] = m[40]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(m)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] + [1.0] * 15, 1), (403, [None] + [1.0] * 15, 1), (None, [1.0] * 16, 1), (404, [1.0] * 3, 1), (7, m[7].tolist(), 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, i int")
    got = neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=10, row_block=64, query_block=8).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == set(range(0, 400, 20))
    x = m.astype(np.float64)
    ids = [*range(400), 7]  # every row is a candidate, the repeated one twice
    for q, found in by.items():
        d = np.sqrt(((x - x[q]) ** 2).cumsum(axis=1)[:, -1])
        want = sorted((d[i], i) for i in ids if i != q)[:10]
        assert [(k + 1, i, s) for k, (s, i) in enumerate(want)] == sorted(found)


def test_nearest_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert neighbours.nearest(df, df.where("vec_id = 0")).collect() == [Row(query_id=0, rank=1, vec_id=1, score=math.sqrt(2))]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_nearest_without_candidates(spark):
    """Queries alone in their table, in their tile or with their vector length; vectors whose squares overflow; repeated queries."""
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = lambda d, **b: sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(d, d.where("vec_id % 100 = 0"), **b).collect())
    assert found(df([(100, [1.0, 2.0])])) == []
    assert found(df([(0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0]), (100, [1.0, 3.0])])) == [(100, 1, 1, 1.0)]
    rows = [(k, [float(k), 1.0]) for k in range(30)]
    assert found(df(rows), row_block=1, query_block=1, k=3) == [(0, k, k, float(k)) for k in (1, 2, 3)]
    assert found(df([(0, [1e200, 1.0]), (1, [-1e200, 1.0]), (2, [1e200, 2.0])]), k=2) == [(0, 1, 2, 1.0), (0, 2, 1, float("inf"))]
    assert found(df([(0, [1.0]), (0, [3.0]), (5, [2.0]), (5, [2.0])]), k=3) == [(0, 1, 5, 1.0), (0, 1, 5, 1.0), (0, 2, 5, 1.0), (0, 2, 5, 1.0)]
