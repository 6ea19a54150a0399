import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelspan.llm import quality, toxicity


def rates(found, labels, column):
    rows = found.join(labels.select(F.col("doc_id").alias("id"), F.col(column).alias("y")), F.col("row.doc_id") == F.col("id")).select("score", "y").collect()
    hit = [r["score"] >= 0.5 for r in rows if r["y"] == 1]
    miss = [r["score"] >= 0.5 for r in rows if r["y"] == 0]
    return len(hit), np.mean(hit), len(miss), np.mean(miss)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.learn(docs, labels, ~held)
    n, recall, m, false = rates(toxicity.score_toxicity(docs.where(held), model, keep=["doc_id"]), labels, "toxic")
    assert n > 50 and recall > 0.85 and m > 300 and false < 0.08


def test_toxicity_gaps():
    bad = ["you are a %s indeed" % w for w in ("scoundrel", "buffoon", "nitwit") for _ in range(6)]
    good = ["the weather is fine today", "we walk to the old house", "bread and butter for lunch", "a quiet evening at home", "you are a friend indeed"] * 8
    model = toxicity.fit([(k, 1, s) for k, s in enumerate(bad)] + [(100 + k, 0, s) for k, s in enumerate(good)])
    scorer = toxicity.Scorer(model.landmarks, model.weights)
    texts = ["Scoundrel!", "scou.ndrel", "buff-oon", "n i t w i t", "BUFFOONS,", "quiet" * 20 + "buffoon" * 6]
    clean, *found = scorer.texts(pa.array(["the quiet house at home", *texts]))
    for t, m in zip(texts, found, strict=True):
        assert model.slope * m + model.shift > 0 > model.slope * clean + model.shift, t


def test_toxicity_of_two_words():
    """Each word stands in clean sentences too; only both together tell."""
    bad = [f"{a} waste of {b} here" for a in ("utter", "sheer") for b in ("space", "air") for _ in range(8)]
    good = ["they waste bread", "a house of stone", "the waste bin is full", "space and air above", "utter silence here", "sheer cliffs of space", "of air and light"] * 10
    model = toxicity.fit([(k, 1, s) for k, s in enumerate(bad)] + [(100 + k, 0, s) for k, s in enumerate(good)])
    scorer = toxicity.Scorer(model.landmarks, model.weights)
    margin = scorer.texts(pa.array(["what a waste of space", "a waste bin of stone", "waste. Of space"]))
    p = [model.slope * m + model.shift > 0 for m in margin]
    assert p == [True, False, False]


def triples(window):
    out = {}
    for i, j, k in itertools.combinations(range(len(window)), 3):
        if k - i < toxicity.SPAN:
            c = (window[i] << 16) | (window[j] << 8) | window[k]
            out[c] = out.get(c, 0) + toxicity.DECAY ** (k - i + 1)
    return out


def kernel(x, y):
    a, b = triples(x), triples(y)
    norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return sum(v * b.get(c, 0) for c, v in a.items()) / norm if norm else 0.0


def test_kernel_matches_enumeration():
    for word in (b" banana", b" idiot", b" ab"):
        want, got = triples(word), toxicity.kernel_features(word)
        assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-12 for c in want)


def plain_windows(text):
    """Windows of a text by loops."""
    out = []
    for sentence in re.split(rb"(?<=[.!?])(?=[ \t\x0b\x0c\r])|\n", text.encode().lower()):
        words = [w for w in (re.sub(rb"^[^a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff]+$", b"", w) for w in re.split(rb"[ \t\x0b\x0c\r]+", sentence)) if w]
        for n in range(1, toxicity.WORDS + 1):
            out += [b" " + b" ".join(x) for x in zip(*[words[k:] for k in range(n)]) if max(map(len, x)) < toxicity.PART]
        for w in words:
            if len(w) >= toxicity.PART:
                step = toxicity.PART // 2
                out += [(b" " + w)[k : k + toxicity.PART] for k in range(0, len(w) + 1 - step, step)]
    return out


def test_windows_and_margins_match_loops():
    r = random.Random(5)
    pieces = ["idiot", "You", "fool!", "a.b", "x-y", "\n", ". ", " ", "  ", "?", "É", "wörter", "z" * 31, "q" * 32, "w" * 80, "--", "mama mama", "\t", "end."]
    texts = ["".join(r.choice([p, p + " "]) for p in r.choices(pieces, k=r.randrange(14))) for _ in range(120)] + ["", None, "...", " . "]
    w = toxicity.windows(pa.array(texts))
    landmarks = [b" idiot", b" fool", b" mama mama", b" you fool", "\u00e9".encode() + b"abc"]
    weights = np.array([1.0, 0.7, -0.4, 0.9, 0.3])
    best, which = toxicity.Scorer(landmarks, weights).best(w, len(texts))
    for k, t in enumerate(texts):
        want = plain_windows(t or "")
        assert sorted(w.get(i) for i in np.flatnonzero(w.text == k).tolist()) == sorted(want), t
        margins = [sum(v * kernel(x, m) for v, m in zip(weights, landmarks, strict=True)) for x in want]
        assert best[k] == pytest.approx(max([0.0, *margins]), abs=1e-9)


def test_nystroem_products_are_kernels():
    marks = toxicity.Landmarks([b" idiot", b" idiots", b" fool", b" old house", b" of bread"])
    got = marks.kernels(marks.landmarks)
    assert np.allclose(got, [[kernel(a, b) for b in marks.landmarks] for a in marks.landmarks])
    mapped = got @ toxicity.nystroem_map(marks)
    assert np.allclose(mapped @ mapped.T, got)
    # other windows: the projection on the landmarks, never longer than the window itself
    other = marks.kernels([b" idiotic", b" house of bread"]) @ toxicity.nystroem_map(marks)
    assert np.all((other**2).sum(axis=1) <= 1 + 1e-9)


def test_quality_matches_loops():
    """Features, attention and score of passages, by plain loops."""
    rng = np.random.default_rng(3)
    texts = ["One two, two two three. " * 30, "", None, "Ünï 12 34!\nx x y", "word", " " * 9, "  led by blanks ", "z", "one two one two one two\n\n"]
    words = quality.Words(pa.array(texts), quality.Powers(), spans=True)
    x, owner = quality.encode(words, 0, len(texts))
    kinds = lambda b: [int(quality._KIND[c]) for c in b]
    rows = []
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        spans = [m.span() for m in re.finditer(rb"[^ \t-\r]+", raw)]
        for a in range(0, max(1, len(spans)), quality.PASSAGE):
            own = spans[a : a + quality.PASSAGE]
            n, f = max(1, len(own)), [0.0] * quality.FEATURES
            w = [raw[i:j].lower() for i, j in own]
            if own:
                f[64] = len(set(w)) / n
                f[65] = sum(p == q for p, q in zip(w, w[1:])) / n
                f[66] = (n - 1 - len(set(zip(w, w[1:])))) / n
                f[67] = sum(not set(kinds(raw[i:j])) & {0, 1, 2, 7} for i, j in own) / n
                f[68] = sum(j - i for i, j in own) / n / 10
                f[69] = len(own) / quality.PASSAGE
                pairs = [p * 8 + q for p, q in zip(kinds(raw[own[0][0] : own[-1][1]]), kinds(raw[own[0][0] : own[-1][1]])[1:])]
                f[:64] = [pairs.count(p) / max(1, len(pairs)) for p in range(64)]
            f[70] = float(not own)
            rows.append((k, f))
    assert owner.tolist() == [k for k, _ in rows]
    assert np.allclose(x, [f for _, f in rows], atol=1e-5)
    for k, t in enumerate(texts):  # alone as amid others
        alone = quality.encode(quality.Words(pa.array([t], pa.string()), quality.Powers(), spans=True), 0, 1)[0]
        assert np.array_equal(alone, x[owner == k])
    w = quality._shape(5, rng)
    first = np.searchsorted(owner, np.arange(len(texts)))
    got = quality._forward(w, x, first)
    for k in range(len(texts)):
        bag = [v.astype(float) for v, o in zip(x, owner, strict=True) if o == k]
        enc = [np.tanh(v @ w["W"] + w["b"]) for v in bag]
        gate = [math.exp(sum(float(w["a"][i]) * math.tanh(float(h @ w["V"][:, i])) / (1 + math.exp(-float(h @ w["U"][:, i]))) for i in range(len(w["a"])))) for h in enc]
        z = sum(g * h for g, h in zip(gate, enc, strict=True)) / sum(gate)
        assert got["logit"][k] == pytest.approx(float(z @ w["c"] + w["d"][0]), rel=1e-5, abs=1e-6)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = quality.learn(docs, labels, ~held)
    n, good, m, false = rates(quality.score_quality(docs.where(held), model, keep=["doc_id"]), labels, "quality")
    assert n > 500 and good > 0.9 and m > 100 and false < 0.2


def test_quality_is_of_the_text_alone(spark):
    """However rows are dealt, reruns give each text one score."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels, F.lit(True))
    scores = [{r["row"]["doc_id"]: r["score"] for r in quality.score_quality(docs.repartition(n), model, keep=["doc_id"]).collect()} for n in (1, 7)]
    assert scores[0].keys() == scores[1].keys() and max(abs(scores[0][k] - scores[1][k]) for k in scores[0]) < 1e-9


def test_quality_learns_from_bounded_rows(spark):
    docs = spark.createDataFrame([(k % 3, f"text {k} " * (1 + k % 5)) for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    seen = []
    fit, quality.fit = quality.fit, lambda bags, y: seen.append(len(bags)) or fit(bags, y)
    try:
        quality.learn(docs, labels, F.lit(True), most_docs=30)
    finally:
        quality.fit = fit
    assert 0 < seen[0] < 100


def test_quality_gradient():
    rng = np.random.default_rng(0)
    w = quality._shape(6, rng)
    x, first, y = rng.normal(size=(9, quality.FEATURES)), np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0])
    loss = lambda w: float(np.sum(np.log1p(np.exp(f := quality._forward(w, x, first)["logit"])) - y * f))
    g = quality._gradient(w, x, first, y, np.ones(3))
    for name in w:
        at = tuple(rng.integers(s) for s in w[name].shape)
        up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
        up[name][at] += 1e-6
        down[name][at] -= 1e-6
        assert abs((loss(up) - loss(down)) / 2e-6 - g[name][at]) < 1e-5


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (None, "fine words here", 0.1), (4, "x" * 300_000, 0.1), (5, "word " * 60_000, 0.1), (2, "", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1), (4, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for part, score in ((quality, quality.score_quality), (toxicity, toxicity.score_toxicity)):
        for model in (part.learn(docs, labels, F.lit(True)), part.learn(docs.limit(0), labels.limit(0), F.lit(True))):
            got = score(docs, model).collect()
            assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
            assert score(docs.limit(0), model).count() == 0
