"""Language ID by unigram pieces with all segmentations summed."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import numbered, with_row
from .scratch import Scratch, make_importable
from .wordhash import LOWER, Powers, Words, mix, slices

#: A public vocabulary of byte pieces; any file of base64 pieces and ranks will do. Only the driver reads it.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Bytes of a word from which on it is scored block by block.
LONG, BLOCK = 4096, 512
#: Bytes after which a word is cut for learning, between two characters; all its parts are learned from. Scoring cuts nothing.
LEARNED_PART = 128
_CACHE = 1 << 21
_BASE = 0x5851F42D4C957F2D
_POWERS = Powers(_BASE)
BLANKS = b" \t\n\x0b\x0c\r"


def read_pieces(path: str) -> list[bytes]:
    """The vocabulary's pieces that can stand in a lower-cased word with a blank before it; single bytes first, all 256 of them."""
    found = {base64.b64decode(x.split()[0]) for x in Path(path).read_bytes().splitlines() if x}
    single = [bytes([k]) for k in range(256)]
    fits = lambda p: p == p.lower() and not any(c in BLANKS for c in p[1:]) and (p[:1] == b" " or p[0] not in BLANKS)
    return single + sorted(p for p in found if len(p) > 1 and fits(p))


class Pieces:
    """Piece numbers by hash: direct tables, each for the pieces that collide in those before."""

    def __init__(self, pieces: list[bytes], bits: int = 18):
        self.n, self.bits, self.tables = len(pieces), bits, []
        self.sizes = sorted({len(p) for p in pieces})
        h = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        ids = np.arange(len(pieces), dtype=np.int32)
        level = 0
        while len(ids):
            at = (mix(h[ids] + np.uint64(level)) >> np.uint64(64 - bits)).astype(np.int64)
            _, first = np.unique(at, return_index=True)
            slots = np.full(1 << bits, -1, dtype=np.int32)
            slots[at[first]] = ids[first]
            self.tables.append(slots)
            ids = np.delete(ids, first)
            level += 1
        self.hash = np.append(h, np.uint64(0))

    @staticmethod
    def _hash(p: bytes) -> int:
        h = 0
        for k, c in enumerate(p):
            h = (h + (c + 1) * pow(_BASE, k, 1 << 64)) % (1 << 64)
        return (h * 2 + len(p)) % (1 << 64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers; n where there is none. A table is asked only about what met another piece in the one before."""
        flat = h.ravel()
        out = np.full(len(flat), self.n, dtype=np.int32)
        rest = np.arange(len(flat))
        for level, slots in enumerate(self.tables):
            own = flat[rest] if level else flat
            at = slots[(mix(own + np.uint64(level)) >> np.uint64(64 - self.bits)).astype(np.int64)]
            taken = np.flatnonzero(at >= 0)
            hit = self.hash[at[taken]] == own[taken]
            out[rest[taken[hit]]] = at[taken[hit]]
            rest = rest[taken[~hit]]
            if not len(rest):
                break
        return out.reshape(h.shape)

    def spans(self, words: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
        """For equally long rows of bytes: by end j the (i, piece numbers of the bytes from i to j), where any row has a piece."""
        n = words.shape[1]
        up, down = _POWERS.upto(n)
        sums = np.zeros((len(words), n + 1), dtype=np.uint64)
        np.cumsum((words.astype(np.uint64) + np.uint64(1)) * up[:n], axis=1, out=sums[:, 1:])
        out: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n + 1)]
        for size in self.sizes:
            if size > n:
                break
            h = (sums[:, size:] - sums[:, : n + 1 - size]) * down[: n + 1 - size] * np.uint64(2) + np.uint64(size)
            ids = self.find(h)
            for i in np.flatnonzero((ids < self.n).any(axis=0)).tolist():
                out[i + size].append((i, ids[:, i]))
        return out


@dataclass
class LanguageModel:
    """Languages in order and, per piece and language, the piece's probability (a last row of zeros)."""

    languages: list[str]
    probability: np.ndarray
    pieces: list[bytes]


def _by_length(raw: np.ndarray, start: np.ndarray, sizes: np.ndarray, cells: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, sizes, byte matrix) of words of about the same length, shortest first, a blank before each and the shorter ones filled up with zeros; sizes count the blank."""
    order = np.argsort(sizes, kind="stable")
    k = 0
    while k < len(order):
        least = sizes[order[k]]
        end = int(np.searchsorted(sizes[order], least + least // 8, side="right"))
        end = min(end, k + max(1, cells // (least + least // 8 + 1)))
        at = order[k:end]
        place = np.arange(int(sizes[at[-1]]))
        inside = place < sizes[at][:, None]
        m = np.full((len(at), len(place) + 1), ord(" "), dtype=np.uint8)
        m[:, 1:] = np.where(inside, LOWER[raw[np.where(inside, start[at][:, None] + place, 0)]], 0)
        yield at, sizes[at] + 1, m
        k = end


def _run(spans: list, alphas: list, p: np.ndarray, first: int, done: Callable[[int, np.ndarray, np.ndarray], None]) -> tuple[list, np.ndarray]:
    """The forward recursion from boundary ``first`` on, with only the last boundaries held.

    ``alphas`` are those of the boundaries before ``first``; of each row and language all are divided by
    their largest value now and then, and the logarithm of what they were divided by is kept. ``done`` gets each boundary with its
    sums and that logarithm. Returns the last boundaries and the logarithm.
    """
    ring = list(alphas)
    scale = np.zeros((ring[-1].shape[0], p.shape[1]))
    longest = len(ring)
    for j in range(first, len(spans)):
        total = np.zeros_like(ring[-1])
        for i, ids in spans[j]:
            back = j - i
            if back <= longest:
                w = p[ids]
                total += ring[-back] * (w if total.ndim == 2 else w[:, None, :])
        ring = [*ring[1:], total]
        if j % 16 == 0:
            top = np.maximum.reduce([r if r.ndim == 2 else r.max(axis=1) for r in ring])
            top[top == 0] = 1
            ring = [r / (top if r.ndim == 2 else top[:, None, :]) for r in ring]
            scale = scale + np.log(top)
        done(j, ring[-1], scale)
    return ring, scale


def _long_score(word: bytes, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Log probability of a very long word.

    What a block does to the sums at the last boundaries (as many as the longest piece in the word has bytes)
    is one matrix per language; blocks get theirs side by side, equal ones once, and the matrices are applied in order.
    """
    x = np.frombuffer(word, dtype=np.uint8)
    step, k = 1 << 16, pieces.sizes[-1]
    longest = 1
    for at in range(0, len(x), step):
        part = x[max(0, at - k) : at + step][None, :]
        longest = max([longest, *(j - i for j, ends in enumerate(pieces.spans(part)) for i, _ in ends)])
    state = np.zeros((longest, p.shape[1]))
    state[-1] = 1
    total = np.zeros(p.shape[1])
    padded = np.concatenate([np.zeros(longest, dtype=np.uint8), x])
    whole = len(x) // BLOCK * BLOCK
    nothing = lambda j, a, s: None
    for at in range(0, len(x), 128 * BLOCK):
        end = min(at + 128 * BLOCK, whole)
        parts = [np.lib.stride_tricks.sliding_window_view(padded[at : end + longest], BLOCK + longest)[::BLOCK]] if end > at else []
        if at + 128 * BLOCK > whole and whole < len(x) and at <= whole:
            parts.append(padded[whole:][None, :])
        for rows in parts:
            unique, which = np.unique(rows, axis=0, return_inverse=True)
            # one row of sums per boundary before the block, each alone set to one
            basis = [np.zeros((len(unique), longest, p.shape[1])) for _ in range(longest)]
            for b in range(longest):
                basis[b][:, b] = 1
            ring, scale = _run(pieces.spans(unique), basis, p, longest + 1, nothing)
            moved = np.stack(ring[-longest:], axis=2)  # row, boundary before, boundary after, language
            for u in which.ravel().tolist():
                state = (state[:, None, :] * moved[u]).sum(axis=0)
                top = state.max(axis=0)
                state = state / top
                total = total + np.log(top) + scale[u]
    return total + np.log(np.maximum(state[-1], 1e-300))


def span_scores(raw: np.ndarray, start: np.ndarray, sizes: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Log probability in each language of each word, ``sizes`` bytes from ``start`` on with a blank before them: all its segmentations summed, whatever its length."""
    out = np.zeros((len(start), p.shape[1]))
    short = np.flatnonzero(sizes < LONG)
    for at, ends, m in _by_length(raw, start[short], sizes[short]):
        found = np.zeros((len(at), p.shape[1]))

        def done(j: int, alpha: np.ndarray, scale: np.ndarray, found=found, ends=ends) -> None:
            lo, hi = np.searchsorted(ends, j, side="left"), np.searchsorted(ends, j, side="right")
            if hi > lo:
                found[lo:hi] = np.log(np.maximum(alpha[lo:hi], 1e-300)) + scale[lo:hi]

        longest = min(pieces.sizes[-1], m.shape[1])
        zero = np.zeros((len(at), p.shape[1]))
        _run(pieces.spans(m), [zero] * (longest - 1) + [np.ones((len(at), p.shape[1]))], p, 1, done)
        out[short[at]] = found
    for k in np.flatnonzero(sizes >= LONG):
        out[k] = _long_score(b" " + LOWER[raw[start[k] : start[k] + sizes[k]]].tobytes(), pieces, p)
    return out


def word_scores(words: list[bytes], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """The same for a list of words."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    return span_scores(np.frombuffer(b"".join(words) + b" ", dtype=np.uint8), np.cumsum(sizes) - sizes, sizes, pieces, p)


def _parts(word: bytes) -> Iterator[bytes]:
    """A word with a blank before it, in parts of about LEARNED_PART bytes, none cut inside a character."""
    word, at = b" " + word, 0
    while len(word) - at > LEARNED_PART:
        end = at + LEARNED_PART
        while end > at + 1 and word[end] & 0xC0 == 0x80:
            end -= 1
        yield word[at:end]
        at = end
    yield word[at:]


def expected_counts(words: list[bytes], times: np.ndarray, vocab: Pieces, p: np.ndarray) -> np.ndarray:
    """How often each piece stands in all segmentations of the words, weighed by their probabilities under ``p``."""
    own = [(part, n) for w, n in zip(words, times, strict=True) for part in _parts(w)]
    sizes, often = np.array([len(w) for w, _ in own], dtype=np.int64), np.array([n for _, n in own], dtype=np.float64)
    soft = np.zeros(vocab.n + 1)
    for n in np.unique(sizes):
        same = np.flatnonzero(sizes == n)
        for c in range(0, len(same), 2048):
            at = same[c : c + 2048]
            spans = vocab.spans(np.frombuffer(b"".join([own[i][0] for i in at]), dtype=np.uint8).reshape(len(at), n))
            # sums are of probabilities times a constant to the power of the bytes, so that they stay in range
            lift = 64.0
            alpha, beta = np.zeros((n + 1, len(at))), np.zeros((n + 1, len(at)))
            alpha[0] = beta[n] = 1
            for j in range(1, n + 1):
                for i, ids in spans[j]:
                    alpha[j] += alpha[i] * p[ids] * lift ** (j - i)
            for j in range(n, 0, -1):
                for i, ids in spans[j]:
                    beta[i] += beta[j] * p[ids] * lift ** (j - i)
            weight = often[at] / np.maximum(alpha[n], 1e-300)
            for j in range(1, n + 1):
                for i, ids in spans[j]:
                    soft += np.bincount(ids, weight * alpha[i] * beta[j] * p[ids] * lift ** (j - i), minlength=vocab.n + 1)
    return soft


def _maximise(expect: Callable[[np.ndarray], np.ndarray], languages: int, n: int, rounds: int, prior: float) -> np.ndarray:
    """Probabilities (piece, language) after some rounds; ``expect`` gives expected counts of all languages under given ones."""
    p = np.full((n + 1, languages), 1.0 / n)
    p[-1] = 0
    for _ in range(rounds):
        soft = expect(p)
        soft[-1] = 0
        p = (soft + prior) / (soft.sum(axis=0) + prior * n)
        p[-1] = 0
    return p


def fit(counts: dict[str, dict[bytes, int]], vocabulary: str = VOCABULARY, rounds: int = 4, prior: float = 0.01) -> LanguageModel:
    """Expectation-maximisation of piece probabilities per language from word counts that are at hand."""
    names = sorted(counts, key=lambda x: x.encode())
    listed = read_pieces(vocabulary)
    vocab = Pieces(listed)

    def expect(p: np.ndarray) -> np.ndarray:
        return np.stack([expected_counts(list(counts[x]), np.array(list(counts[x].values())), vocab, p[:, k]) for k, x in enumerate(names)], axis=1)

    return LanguageModel(names, _maximise(expect, len(names), vocab.n, rounds, prior), listed)


def _expected(listed: list[bytes], names: list[str], p: np.ndarray):
    """(language, piece, soft): a task's expected counts of its words."""
    schema = pa.schema([("language", pa.int32()), ("piece", pa.int32()), ("soft", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _pieces(tuple(listed))
        soft = np.zeros((vocab.n + 1, len(names)))
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            words, times = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for k in range(len(names)):
                own = np.flatnonzero(langs == names[k])
                if len(own):
                    soft[:, k] += expected_counts([words[i].encode() for i in own], times[own], vocab, p[:, k])
        piece, language = np.nonzero(soft)
        yield pa.record_batch([pa.array(language.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(soft[piece, language])], schema=schema)

    return run


def learn(docs: DataFrame, learnable: Column, per_language: int = 400, vocabulary: str = VOCABULARY, rounds: int = 4, prior: float = 0.01) -> LanguageModel:
    """Fit on a sample of about ``per_language`` documents of each language among the ``learnable`` rows.

    The sample is drawn by the hash of doc_id at a rate from each language's count, the one bound there is: all words of its whole
    texts are learned from, long ones in parts. They are counted by Spark, and each round of expectation-maximisation is a
    job over the counts, of which the driver gets one number for each piece and language.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "langid")
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable)
    rates = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    rate = {r["lang"]: min(1.0, per_language / r["n"]) for r in rates.collect()}
    if not rate:
        return LanguageModel([], np.zeros((1, 0)), [])
    chance = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20)) / F.lit(1 << 20)
    keep = F.lit(False)
    for name, r in rate.items():
        keep = F.when(F.col("lang") == name, chance < r).otherwise(keep)
    words = rows.where(keep).select("lang", F.explode(F.split(F.btrim(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")).alias("word"))
    counted = scratch.write(words.where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).repartition("lang", "word"), "words")
    names, listed = sorted(rate, key=lambda x: x.encode()), read_pieces(vocabulary)
    n = len(listed)

    def expect(p: np.ndarray) -> np.ndarray:
        found = counted.mapInArrow(_expected(listed, names, p), "language int, piece int, soft double").groupBy("language", "piece").agg(F.array_sort(F.collect_list("soft")).alias("soft")).toPandas()
        soft = np.zeros((n + 1, len(names)))
        soft[found["piece"], found["language"]] = [sum(x) for x in found["soft"]]
        return soft

    return LanguageModel(names, _maximise(expect, len(names), n, rounds, prior), listed)


@lru_cache(maxsize=1)
def _pieces(listed: tuple[bytes, ...]) -> Pieces:
    """The vocabulary's tables, built once by each worker and not for each of its tasks."""
    return Pieces(list(listed))


def _score(model: LanguageModel, text_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, pieces = Powers(), _pieces(tuple(model.pieces))
        n = len(model.languages)
        most = max(1 << 14, _CACHE // (n + 2))
        known, values = np.zeros(0, dtype=np.uint64), np.zeros((0, n))
        for batch in slices(batches, text_column):
            texts = batch.column(text_column)
            words = Words(texts, powers, spans=True)
            totals = np.zeros((len(texts), n))
            cuts = _cuts(words.first, 1 << 17)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                lo, hi = words.first[a], words.first[b]
                if lo == hi or not n:
                    continue
                if len(known) > most:
                    known, values = known[:0], values[:0]
                unique, first, where = np.unique(words.hash[lo:hi], return_index=True, return_inverse=True)
                new = np.ones(len(unique), dtype=bool)
                if len(known):
                    new = known[np.minimum(np.searchsorted(known, unique), len(known) - 1)] != unique
                if new.any():
                    at = lo + first[new]
                    fresh = span_scores(words.raw, words.start[at], words.end[at] - words.start[at], pieces, model.probability)
                    known, values = np.concatenate([known, unique[new]]), np.concatenate([values, fresh])
                    order = np.argsort(known)
                    known, values = known[order], values[order]
                filled = a + np.flatnonzero(np.diff(words.first[a : b + 1]))
                totals[filled] = np.add.reduceat(values[np.searchsorted(known, unique)[where]], words.first[filled] - lo)
            readable = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best, score = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
            if n:
                best = totals.argmax(axis=1)
                share = np.exp(totals - totals.max(axis=1)[:, None])
                score = np.where(readable, share.max(axis=1) / share.sum(axis=1), 0.0)
            names = pa.array([*model.languages, "und"], pa.string()).take(pa.array(np.where(readable & (n > 0), best, n)))
            yield pa.RecordBatch.from_arrays([*batch.columns, names, pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return run


def _cuts(first: np.ndarray, words: int) -> list[int]:
    """Text numbers between which there are about so many words."""
    out = [0]
    while out[-1] < len(first) - 1:
        out.append(max(out[-1] + 1, int(np.searchsorted(first, first[out[-1]] + words, side="right")) - 1))
    return out


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """Predict the language of every whole text.

    A word, of any length, is scored by the sum over all its segmentations into vocabulary pieces (forward
    algorithm), a text by the product over its words, equal priors. Scores of words are remembered inside a
    task, in bounded memory.

    Returns ``row`` (a struct of the ``keep`` columns, all by default), ``lang_pred`` and ``score`` (its
    share of the languages' probability). A null text and one without a letter give ``und`` and 0; so do
    all texts if nothing was learned. Repeated rows and ids are scored one by one; ties go to the first
    language in code point order. An empty table gives no rows.
    """
    make_importable(docs.sparkSession)
    packed, text = numbered(docs, keep)
    kind = T.StructType([*packed.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return with_row(packed.mapInArrow(_score(model, text), kind), docs, keep, "lang_pred", "score")
