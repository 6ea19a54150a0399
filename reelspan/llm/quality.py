"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .langid import _cuts
from .scratch import Scratch, make_importable
from .wordhash import Powers, Words, slices

#: Words of a passage.
PASSAGE = 48
#: Kinds of bytes: lower case, upper case, digit, space, newline, stop or comma, other sign, byte of a longer character.
KINDS = 8
_KIND = np.full(256, 6, dtype=np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[32, 9]], _KIND[[10, 13]], _KIND[[44, 46]], _KIND[128:] = 0, 1, 2, 3, 4, 5, 7
FEATURES = KINDS * KINDS + 7


def passages(words: Words, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of every passage of texts a to b; a text without words has one passage without words."""
    counts = np.diff(words.first[a : b + 1])
    per_text = np.maximum(1, -(-counts // PASSAGE))
    text = np.repeat(np.arange(a, b), per_text)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    return words.first[text] + number * PASSAGE, text


def encode(words: Words, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, text) of the passages of texts a to b.

    Features: frequencies of pairs of byte kinds between the start of the passage's first word and the end of its
    last, share of words that are distinct, that repeat the one before, that repeat an earlier pair, that have no
    letter, mean word length, share of the passage that is filled, and whether it is empty. So they depend on the
    passage alone, not on what stands around it.
    """
    start, text = passages(words, a, b)
    end = np.minimum(start + PASSAGE, words.first[text + 1])
    size = np.maximum(1, end - start)
    n = len(start)
    out = np.zeros((n, FEATURES), dtype=np.float32)
    empty = end == start
    lo, hi = words.first[a], words.first[b]
    if lo < hi:
        byte0, byte1 = int(words.start[lo]), int(words.end[hi - 1])
        kind = _KIND[words.raw[byte0:byte1]]
        full = np.flatnonzero(~empty)
        first_byte, size_in_bytes = words.start[start[full]] - byte0, words.end[end[full] - 1] - words.start[start[full]]
        owner = np.repeat(full, size_in_bytes - 1)
        at = np.arange(len(owner)) + np.repeat(first_byte - np.cumsum(size_in_bytes - 1) + size_in_bytes - 1, size_in_bytes - 1)
        pair = kind[at] * KINDS + kind[at + 1]
        pairs = np.bincount(owner * KINDS * KINDS + pair, minlength=n * KINDS * KINDS).reshape(n, -1)
        out[:, : KINDS * KINDS] = pairs / np.maximum(1, pairs.sum(axis=1))[:, None]
        h = words.hash[lo:hi]
        mine = np.repeat(np.flatnonzero(~empty), (end - start)[~empty])

        def distinct(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
            order = np.lexsort((x, owner))
            o, v = owner[order], x[order]
            new = np.ones(len(x), dtype=bool)
            new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
            return np.bincount(o[new], minlength=n)

        k = KINDS * KINDS
        inside = mine[1:] == mine[:-1]
        same = inside & (h[1:] == h[:-1])
        out[:, k] = distinct(h, mine) / size
        out[:, k + 1] = np.bincount(mine[1:][same], minlength=n) / size
        two = h[:-1] * np.uint64(3) + h[1:]
        out[:, k + 2] = (np.bincount(mine[1:][inside], minlength=n) - distinct(two[inside], mine[1:][inside])) / size
        sign = np.concatenate([[0], np.cumsum(np.isin(kind, (0, 1, 2, 7)))])
        bare = sign[words.end[lo:hi] - byte0] == sign[words.start[lo:hi] - byte0]
        out[:, k + 3] = np.bincount(mine[bare], minlength=n) / size
        out[:, k + 4] = np.bincount(mine, words.end[lo:hi] - words.start[lo:hi], minlength=n) / size / 10
        out[:, k + 5] = (end - start) / PASSAGE
    out[:, KINDS * KINDS + 6] = empty
    return out, text


@dataclass
class QualityModel:
    """Scales of the features and the network's weights."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]


def _shape(width: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    r = lambda *s: rng.normal(size=s) / np.sqrt(s[0])
    return {"W": r(FEATURES, width), "b": np.zeros(width), "V": r(width, 16), "U": r(width, 16), "a": r(16), "c": r(width), "d": np.zeros(1)}


def _forward(w: dict, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Passage encodings, gated attention inside each text, and the text's logit; ``first`` are the texts' first passages."""
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-h @ w["U"]))
    e = (t * g) @ w["a"]
    own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    s = np.exp(e - np.maximum.reduceat(e, first)[own])
    s = s / np.add.reduceat(s, first)[own]
    z = np.add.reduceat(s[:, None] * h, first)
    return {"h": h, "t": t, "g": g, "s": s, "own": own, "z": z, "logit": z @ w["c"] + w["d"][0]}


def _gradient(w: dict, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(w, x, first)
    d = weight * (1 / (1 + np.exp(-f["logit"])) - y)
    own, h, s = f["own"], f["h"], f["s"]
    dz = d[:, None] * w["c"]
    ds = (dz[own] * h).sum(axis=1)
    de = s * (ds - np.add.reduceat(s * ds, first)[own])
    dt, dg = de[:, None] * f["g"] * w["a"] * (1 - f["t"] ** 2), de[:, None] * f["t"] * w["a"] * f["g"] * (1 - f["g"])
    dh = (s[:, None] * dz[own] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h**2)
    return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ d, "d": np.array([d.sum()])}


def fit(features: list[np.ndarray], labels: np.ndarray, width: int = 24, epochs: int = 40, batch: int = 128, seed: int = 7) -> QualityModel:
    """Train with Adam on bags of passages, one per document; both labels weigh the same in the gradient, the shift is set back to their true odds at the end."""
    rng = np.random.default_rng(seed)
    stacked = np.concatenate(features) if features else np.zeros((1, FEATURES))
    mean, scale = stacked.mean(axis=0), stacked.std(axis=0) + 1e-3
    w = _shape(width, rng)
    share = float(labels.mean()) if len(labels) else 0.5
    if not 0 < share < 1:
        w = {k: np.zeros_like(v) for k, v in w.items()}
        w["d"][0] = 4.0 if share == 1 else -4.0
        return QualityModel(mean, scale, w)
    bags = [((f - mean) / scale).clip(-8, 8) for f in features]
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        order = rng.permutation(len(bags))
        for k in range(0, len(order), batch):
            at = order[k : k + batch]
            sizes = [len(bags[i]) for i in at]
            g = _gradient(w, np.concatenate([bags[i] for i in at]), np.concatenate([[0], np.cumsum(sizes)[:-1]]), labels[at], balance[at] / len(at))
            step += 1
            for name in w:
                grad = g[name] + (1e-4 * w[name] if name in "WVU" else 0)
                m[name] = 0.9 * m[name] + 0.1 * grad
                v[name] = 0.999 * v[name] + 0.001 * grad**2
                w[name] = w[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
    return QualityModel(mean, scale, w)


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, most_docs: int = 4000, passages_per_doc: int = 64) -> QualityModel:
    """Fit on about ``most_docs`` labelled documents, half of each label if there are so many, drawn by hash at rates from their counts.

    Passages are encoded where the documents are; only their features reach the driver, of a document with
    more than ``passages_per_doc`` passages that many evenly spaced ones. Rows of one id with equal features count once,
    and if ids repeat so that there are more than twice ``most_docs`` rows, that many are drawn by hash. Both parameters bound
    what the driver holds; scoring has no bounds. Rows with a null id, text or label are not learned from.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & learnable).select(F.col("doc_id").alias("id"), (F.col("quality") > 0).cast("int").alias("y")).groupBy("id").agg(F.max("y").alias("y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = F.pmod(F.xxhash64(F.lit("quality"), "id"), F.lit(1 << 20)) / F.lit(1 << 20)
    rate = F.when(F.col("y") == 1, most_docs / 2 / max(1, n.get(1, 0))).otherwise(most_docs / 2 / max(1, n.get(0, 0)))
    drawn = scratch.write(known.where(chance < rate), "drawn")
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("id"))
    bags = texts.select(F.col("id").cast("string").alias("id"), "y", "text").mapInArrow(_bags(passages_per_doc), "id string, y int, bag binary")
    rows = scratch.write(bags.distinct(), "bags")
    odds = 2 * most_docs / max(1, rows.count())
    place = F.pmod(F.xxhash64(F.lit("row"), "id", "bag"), F.lit(1 << 20)) / F.lit(1 << 20)
    got = rows.where(place < odds).toPandas().sort_values(["id", "bag"])
    bags = [np.frombuffer(b, dtype=np.float32).reshape(-1, FEATURES).astype(np.float64) for b in got["bag"]]
    return fit(bags, got["y"].to_numpy(dtype=np.float64))


def _bags(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in slices(batches):
            words = Words(batch.column("text"), powers, spans=True)
            bags = []
            for k in range(batch.num_rows):
                x = encode(words, k, k + 1)[0]
                bags.append(x[np.unique(np.linspace(0, len(x) - 1, min(most, len(x))).astype(np.int64))].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(bags, pa.binary())], names=["id", "y", "bag"])

    return run


def _score(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in slices(batches):
            words = Words(batch.column("text"), powers, spans=True)
            scores = np.zeros(batch.num_rows)
            cuts = _cuts(words.first + np.arange(batch.num_rows + 1), 1 << 18)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                x, text = encode(words, a, b)
                first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
                f = _forward(model.weights, ((x - model.mean) / model.scale).clip(-8, 8), first)
                scores[a:b] = 1 / (1 + np.exp(-np.clip(f["logit"], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64())], names=["row", "score"])

    return run


def score_quality(docs: DataFrame, model: QualityModel, keep: list[str] | None = None) -> DataFrame:
    """Score every whole text, 0 to 1; higher is better.

    A text is cut into passages of ``PASSAGE`` words, each is encoded, gated attention weighs them, and the
    weighted encoding gives the score. Returns ``row`` (a struct of the ``keep`` columns, all by default)
    and ``score``. Null and empty texts are one empty passage. Repeated rows and ids are scored one by
    one. An empty table gives no rows.
    """
    make_importable(docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), "text")
    return packed.mapInArrow(_score(model), T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType())]))
