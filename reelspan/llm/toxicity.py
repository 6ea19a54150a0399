"""Toxicity by a support vector machine over a gapped subsequence kernel with Nyström landmarks, trained on labelled sentences."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, make_importable
from .wordhash import LOWER, SPACE, give_back, mix, slices, utf8

#: Three characters within so many, each further place costing this factor.
SPAN, DECAY = 5, 0.6
#: Words of a window; bytes of a word from which on it is read in overlapping parts of that length.
WORDS, PART = 3, 32
#: What a clean document's largest window weighs more than others in training.
LEADING = 10
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]

_LETTER = np.zeros(256, dtype=bool)
_LETTER[48:58] = _LETTER[97:123] = _LETTER[128:] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[33, 46, 63]] = True


@dataclass
class Windows:
    """Windows of texts: up to ``WORDS`` words in a row of one sentence, a blank before them.

    ``bytes`` has all texts, A-Z lower-cased, with one blank before each word; signs at the ends of words are
    gone, those inside words stay. A window is ``size`` bytes from ``start`` on and belongs to ``text``.
    """

    bytes: np.ndarray
    start: np.ndarray
    size: np.ndarray
    text: np.ndarray

    def get(self, k: int) -> bytes:
        return self.bytes[self.start[k] : self.start[k] + self.size[k]].tobytes()


def windows(texts: pa.Array) -> Windows:
    raw, off = utf8(texts)
    x = LOWER[raw[off[0] : off[-1]]]
    off = off - off[0]
    n = len(x)
    letter, blank = _LETTER[x], SPACE[x]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    # a run of signs becomes one blank if it holds a blank or stands at an end of a text
    other = ~letter
    first = np.flatnonzero(other & (np.concatenate([[True], letter[:-1]]) | edge[:-1])) if n else np.zeros(0, dtype=np.int64)
    gap = np.zeros(0, dtype=bool)
    if len(first):
        holds = np.concatenate([[0], np.cumsum(blank)])
        last = np.flatnonzero(other & (np.concatenate([letter[1:], [True]]) | edge[1:])) + 1
        gap = (holds[last] > holds[first]) | edge[first] | edge[last]
    is_gap = np.zeros(n, dtype=bool)
    if len(first):
        mark = np.zeros(n + 1, dtype=np.int64)
        np.add.at(mark, first[gap], 1)
        np.add.at(mark, last[gap], -1)
        is_gap = np.cumsum(mark[:-1]) > 0
    inside = ~is_gap
    begins = inside & (np.concatenate([[True], is_gap[:-1]]) | edge[:-1]) if n else inside
    ends = inside & (np.concatenate([is_gap[1:], [True]]) | edge[1:]) if n else inside
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    # sentences: a stop before white space, or a line's end
    stop = (_STOP[x] & np.concatenate([blank[1:], [True]])) | (x == 10) if n else np.zeros(0, dtype=bool)
    sentence = np.concatenate([[0], np.cumsum(stop)])[s]
    text = np.searchsorted(off, s, side="right") - 1
    # one blank and the word's bytes, word after word
    size = e - s
    at = np.cumsum(size + 1) - size - 1
    packed = np.full(int(size.sum()) + len(size), 32, dtype=np.uint8)
    packed[np.repeat(at + 1 - s, size) + np.flatnonzero(inside)] = x[inside]
    whole = np.flatnonzero(size < PART)
    starts, sizes, owners = [at[whole]], [size[whole] + 1], [text[whole]]
    for k in range(2, WORDS + 1):
        i = np.arange(len(size) - k + 1)
        ok = (text[i] == text[i + k - 1]) & (sentence[i] == sentence[i + k - 1])
        for j in range(k):
            ok &= size[i + j] < PART
        i = i[ok]
        starts.append(at[i])
        sizes.append(at[i + k - 1] + size[i + k - 1] + 1 - at[i])
        owners.append(text[i])
    for i in np.flatnonzero(size >= PART).tolist():
        cuts = np.arange(0, size[i] + 1 - PART // 2, PART // 2)
        starts.append(at[i] + cuts)
        sizes.append(np.minimum(PART, size[i] + 1 - cuts))
        owners.append(np.full(len(cuts), text[i]))
    kind = np.int32 if len(packed) < 1 << 31 else np.int64
    return Windows(packed, *(np.concatenate(c).astype(kind) for c in (starts, sizes, owners)))


def spelled(seen: Windows) -> tuple[np.ndarray, list[str]]:
    """Texts that hold three words or more of one letter in a row, and those letters put together."""
    owner, found = [], []
    one = np.flatnonzero(seen.size == 2)
    if len(one):
        linked = (np.diff(seen.start[one]) == 2) & (np.diff(seen.text[one]) == 0)
        for run in np.split(one, np.flatnonzero(~linked) + 1):
            if len(run) > 2:
                owner.append(int(seen.text[run[0]]))
                found.append(bytes(seen.bytes[seen.start[run] + 1]).decode())
    return np.array(owner, dtype=np.int64), found


def _features(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights of the gapped triples of equally long windows, one row each."""
    codes, weights = [], []
    n = m.shape[1]
    x = m.astype(np.int64)
    for a, b in _OFFSETS:
        if n > b:
            codes.append((x[:, : n - b] << 16) | (x[:, a : n - b + a] << 8) | x[:, b:])
            weights.append(np.full(n - b, DECAY ** (b + 1)))
    if not codes:
        return np.zeros((len(m), 0), dtype=np.int64), np.zeros(0)
    return np.concatenate(codes, axis=1), np.concatenate(weights)


def _norms(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Square roots of the windows' kernels with themselves; a triple that repeats adds up first."""
    order = np.argsort(codes, axis=1, kind="stable")
    c, w = np.take_along_axis(codes, order, axis=1), weights[order]
    start = np.ones(c.shape, dtype=bool)
    start[:, 1:] = c[:, 1:] != c[:, :-1]
    sums = np.add.reduceat(w.ravel(), np.flatnonzero(start.ravel()))
    rows = np.repeat(np.arange(len(c)), start.sum(axis=1))
    return np.sqrt(np.bincount(rows, sums**2, minlength=len(c)))


def kernel_features(window: bytes) -> dict[int, float]:
    """Weights of a window's gapped triples, summed."""
    out: dict[int, float] = defaultdict(float)
    codes, weights = _features(np.frombuffer(window, dtype=np.uint8)[None, :])
    for c, w in zip(codes[0].tolist(), weights.tolist(), strict=True):
        out[c] += w
    return out


def _unit(window: bytes) -> dict[int, float]:
    own = kernel_features(window)
    norm = math.sqrt(sum(v * v for v in own.values())) or 1.0
    return {c: v / norm for c, v in own.items()}


def _by_size(items: list[bytes], most: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = np.array([len(x) for x in items])
    for n in np.unique(sizes):
        same = np.flatnonzero(sizes == n)
        for k in range(0, len(same), most):
            at = same[k : k + most]
            yield at, np.frombuffer(b"".join([items[i] for i in at]), dtype=np.uint8).reshape(len(at), n)


class Landmarks:
    """Normalised kernels of windows with a fixed list of windows."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = landmarks
        found: dict[int, dict[int, float]] = defaultdict(dict)
        for k, w in enumerate(landmarks):
            for c, v in _unit(w).items():
                found[c][k] = v
        self.codes = np.array(sorted(found), dtype=np.int64)
        self.table = np.zeros((len(found) + 1, len(landmarks)))
        for row, c in enumerate(self.codes.tolist()):
            for k, v in found[c].items():
                self.table[row, k] = v

    def kernels(self, items: list[bytes]) -> np.ndarray:
        out = np.zeros((len(items), len(self.landmarks)))
        for at, m in _by_size(items):
            codes, weights = _features(m)
            if not codes.shape[1] or not len(self.codes):
                continue
            place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            place[self.codes[place] != codes] = len(self.codes)
            total = np.zeros((len(at), len(self.landmarks)))
            for j in range(codes.shape[1]):
                total += self.table[place[:, j]] * weights[j]
            out[at] = total / _norms(codes, weights)[:, None]
        return out


def nystroem_map(marks: Landmarks) -> np.ndarray:
    """The matrix that turns kernels with the landmarks into features whose products are kernels, exactly so between landmarks."""
    values, vectors = np.linalg.eigh(marks.kernels(marks.landmarks))
    keep = values > 1e-6 * values.max()
    return vectors[:, keep] / np.sqrt(values[keep])


class Scorer:
    """Largest margins over windows.

    A window's margin is its kernels with the landmarks, weighted. As the kernel is linear in the triples, all
    landmarks together give each triple one number, and a window's sum of them is a difference of running sums. A
    window without repeated triples has the smallest norm of its length, which bounds its margin from above;
    norms are computed, for those windows only that may be a text's largest. A window below 0 counts as 0.
    """

    def __init__(self, landmarks: list[bytes], weights: np.ndarray):
        marks = Landmarks(landmarks)
        self.codes, self.values = marks.codes, marks.table[:-1] @ weights
        self.quick = np.zeros(1 << 24, dtype=np.float32)
        self.quick[self.codes] = self.values
        n = np.arange(WORDS * (PART + 1) + 1)
        self.least_norm = np.sqrt(np.maximum(1e-12, sum(np.maximum(0, n - b) * DECAY ** (2 * (b + 1)) for _, b in _OFFSETS)))

    def exact(self, items: list[bytes]) -> np.ndarray:
        out = np.zeros(len(items))
        for at, m in _by_size(items):
            codes, weights = _features(m)
            if codes.shape[1] and len(self.codes):
                place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
                out[at] = (np.where(self.codes[place] == codes, self.values[place], 0.0) * weights).sum(axis=1) / _norms(codes, weights)
        return out

    def bounds(self, w: Windows) -> np.ndarray:
        """Upper bounds of the windows' margins."""
        x = w.bytes.astype(np.int32)
        total = np.zeros(len(w.start))
        for b in range(2, SPAN):
            if len(x) <= b:
                continue
            each = np.zeros(len(x) - b, dtype=np.float32)
            for a in range(1, b):
                each += self.quick[(x[: len(x) - b] << 16) | (x[a : len(x) - b + a] << 8) | x[b:]]
            sums = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
            start = np.minimum(w.start, len(each))
            end = np.maximum(start, np.minimum(w.start + w.size - b, len(each)))
            total += DECAY ** (b + 1) * (sums[end] - sums[start])
        return total / self.least_norm[w.size] + 1e-4

    def best(self, w: Windows, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of n texts the largest margin over its windows (0 if none is above) and that window's number (-1 if none)."""
        best, which = np.zeros(n), np.full(n, -1, dtype=np.int64)
        bound = self.bounds(w)
        order = np.flatnonzero(bound > 1.1e-4)
        order = order[np.lexsort((-bound[order], w.text[order]))]
        text = w.text[order]
        rank = np.arange(len(order)) - np.searchsorted(text, text)
        low, high = 0, 1
        while len(order):
            now = (rank < high) & (rank >= low) & (bound[order] > best[text])
            at = order[now]
            # equal windows are computed once
            items = [w.get(k) for k in at.tolist()]
            different = list(dict.fromkeys(items))
            value = dict(zip(different, self.exact(different).tolist(), strict=True))
            for k, item in zip(at.tolist(), items, strict=True):
                if value[item] > best[w.text[k]]:
                    best[w.text[k]], which[w.text[k]] = value[item], k
            left = (rank >= high) & (bound[order] > best[text])
            order, text, rank = order[left], text[left], rank[left]
            low, high = high, 4 * high
        return best, which

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Largest margin of every text, spelled out words included."""
        seen = windows(texts)
        best, _ = self.best(seen, len(texts))
        owner, joined = spelled(seen)
        if joined:
            np.maximum.at(best, owner, self.best(windows(pa.array(joined, pa.string())), len(joined))[0])
        return best


@dataclass
class ToxicityModel:
    """A text's margin is the largest ``kernels with landmarks @ weights`` of its windows, or 0; its score the logistic of ``slope * margin + shift``."""

    landmarks: list[bytes]
    weights: np.ndarray
    slope: float
    shift: float


def _hashed(w: Windows) -> np.ndarray:
    """64 bits of each window."""
    out = np.zeros(len(w.start), dtype=np.uint64)
    for k in range(int(w.size.max(initial=0))):
        long = np.flatnonzero(w.size > k)
        out[long] = mix(out[long] * np.uint64(0x9E3779B97F4A7C15) + w.bytes[w.start[long] + k].astype(np.uint64) + np.uint64(1))
    return out


class _Sentences:
    """Labelled sentences in blocks; windows are made block by block, whenever they are read."""

    def __init__(self, sentences: list[tuple[int, int, str]], block: int = 1 << 17):
        self.docs = sorted({d for d, _, _ in sentences})
        number = {d: k for k, d in enumerate(self.docs)}
        self.label = np.zeros(len(self.docs), dtype=np.int64)
        self.blocks: list[tuple[pa.Array, np.ndarray]] = []
        texts: list[str] = []
        owner: list[int] = []
        held = 0
        for d, y, t in sentences:
            self.label[number[d]] = max(y, self.label[number[d]])
            texts.append(t)
            owner.append(number[d])
            held += len(t)
            if held > block:
                self._close(texts, owner)
                texts, owner, held = [], [], 0
        self._close(texts, owner)

    def _close(self, texts: list[str], owner: list[int]) -> None:
        if texts:
            self.blocks.append((pa.array(texts, pa.string()), np.array(owner, dtype=np.int32)))

    def windows(self) -> Iterator[tuple[Windows, np.ndarray]]:
        for texts, owner in self.blocks:
            yield windows(texts), owner

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Hashes of all windows, in order; how many toxic and clean documents hold each; its number of words if it is longer than two bytes, else 0; and (hash, document) pairs."""
        pairs, sizes = [], []
        for w, owner in self.windows():
            h = _hashed(w)
            blanks = np.concatenate([[0], np.cumsum(w.bytes == 32)])
            words = np.where(w.size > 3, blanks[w.start + w.size] - blanks[w.start], 0).astype(np.int8)
            known, first, where = np.unique(h, return_index=True, return_inverse=True)
            sizes.append((known, words[first]))
            once = np.unique(where.astype(np.int64) * len(self.docs) + owner[w.text])
            pairs.append((known[once // len(self.docs)], (once % len(self.docs)).astype(np.int32)))
        known, first = np.unique(np.concatenate([k for k, _ in sizes]), return_index=True) if sizes else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        words = np.concatenate([x for _, x in sizes])[first] if sizes else np.zeros(0, dtype=np.int8)
        del sizes
        doc_of = []
        while pairs:
            h, d = pairs.pop()
            doc_of.append(np.searchsorted(known, h).astype(np.int64) * len(self.docs) + d)
        once = np.unique(np.concatenate(doc_of)) if doc_of else np.zeros(0, dtype=np.int64)
        del doc_of
        item, doc = once // max(1, len(self.docs)), once % max(1, len(self.docs))
        bad, good = (np.bincount(item[self.label[doc] == k], minlength=len(known)) for k in (1, 0))
        return known, bad, good, words, (item, doc)

    def texts(self, wanted: np.ndarray) -> dict[int, bytes]:
        """Bytes of the windows with the (sorted) wanted hashes."""
        found: dict[int, bytes] = {}
        for w, _ in self.windows():
            h, first = np.unique(_hashed(w), return_index=True)
            for k in np.flatnonzero(np.isin(h, wanted)).tolist():
                found.setdefault(int(h[k]), w.get(int(first[k])))
        return found

    def drawn(self, share: float) -> Iterator[bytes]:
        """Windows of clean documents drawn by hash."""
        for w, owner in self.windows():
            h = _hashed(w)
            chosen = (h >> np.uint64(11)).astype(np.float64) / (1 << 53) < share
            for k in np.flatnonzero(chosen & (self.label[owner[w.text]] == 0)).tolist():
                yield w.get(k)

    def best(self, scorer: Scorer) -> tuple[np.ndarray, list[tuple[float, bytes, int]]]:
        """Largest margin of each document; and of each clean sentence (margin, window, document), largest first."""
        margins, found = np.zeros(len(self.docs)), []
        for w, owner in self.windows():
            margin, which = scorer.best(w, len(owner))
            np.maximum.at(margins, owner, margin)
            found += [(float(margin[k]), w.get(int(which[k])), int(owner[k])) for k in np.flatnonzero((which >= 0) & (self.label[owner] == 0)).tolist()]
        return margins, sorted(found, key=lambda x: (-x[0], x[1], x[2]))


def fit(sentences: list[tuple[int, int, str]], landmarks: int = 128, rounds: int = 3, penalty: float = 1e-4, negatives: int = 6_000) -> ToxicityModel:
    """Fit on labelled sentences (document, label, text).

    A toxic document's sentences share its label, but few are to blame: each toxic document is represented
    by the windows that tell the labels apart best and by the one with the largest margin, which is learned
    again from round to round; documents without a window that toxic ones hold more often stay out.
    Every sentence of a clean document is clean: the window with its largest margin joins the training set from
    round to round, up to ``negatives`` of the largest ones and about as many drawn by hash; a window that is the
    largest of whole documents weighs more. Landmarks are the windows that tell the labels apart best, unlike each
    other, and clean ones: frequent words and those nearest to the others. A window of several words is taken only
    where it tells the labels apart better than any window in it.
    """
    data = _Sentences(sentences)
    n_bad, n_good = int(data.label.sum()), int((1 - data.label).sum())
    if not n_bad or not n_good:
        return ToxicityModel([b" none"], np.zeros(1), 0.0, 4.0 if n_bad else -4.0)
    known, bad, good, words, (item, doc) = data.counts()
    odds = np.log((bad + 0.1) / (n_bad + 0.2)) - np.log((good + 0.1) / (n_good + 0.2))
    strength = odds * np.sqrt(bad)
    held = np.flatnonzero((bad > 0) & (odds > 1.0) & ((words == 1) | ((words > 1) & (bad >= 3))))
    frequent = np.flatnonzero(words == 1)
    frequent = frequent[np.lexsort((known[frequent], -good[frequent]))][:2000]
    text_of = data.texts(np.unique(known[np.concatenate([held, frequent])]))
    texts = {k: text_of[int(known[k])] for k in held.tolist()}
    stronger = {t: float(strength[k]) for k, t in texts.items()}

    def tells_more(k: int) -> bool:
        parts = texts[k][1:].split(b" ")
        inner = [b" " + b" ".join(parts[a:b]) for a in range(len(parts)) for b in range(a + 1, len(parts) + 1) if b - a < len(parts)]
        return all(strength[k] > 1.05 * stronger.get(x, 0.0) for x in inner)

    held = np.array([k for k in held.tolist() if tells_more(k)], dtype=np.int64)
    held = held[np.lexsort((known[held], -strength[held]))]
    chosen: list[bytes] = []
    units: list[dict[int, float]] = []
    for k in held[: 20 * landmarks].tolist():
        if len(chosen) >= landmarks * 2 // 3:
            break
        own = _unit(texts[k])
        if odds[k] > 1.5 and all(sum(v * o.get(c, 0.0) for c, v in own.items()) < 0.85 for o in units):
            chosen.append(texts[k])
            units.append(own)
    chosen = chosen or [texts[int(held[0])] if len(held) else b" none"]
    place = np.full(len(known), -1, dtype=np.int64)
    place[held] = np.arange(len(held))
    mine = (data.label[doc] == 1) & (place[item] >= 0)
    of_doc: dict[int, list[int]] = defaultdict(list)
    for k, d in zip(place[item[mine]].tolist(), doc[mine].tolist(), strict=True):
        of_doc[d].append(k)
    names, strong, rare = [texts[k] for k in held.tolist()], strength[held], odds[held]
    usual = [text_of[int(known[k])] for k in frequent.tolist()]
    share = negatives / max(1, int(good.sum()))
    del known, bad, good, words, item, doc, odds, strength, place, mine, text_of, texts, stronger

    def hardest(scorer: Scorer) -> tuple[np.ndarray, dict[bytes, int]]:
        """Margins of the documents; and clean windows, largest first, with the number of documents whose largest it is."""
        margins, rows = data.best(scorer)
        found: dict[bytes, int] = {}
        led: set[int] = set()
        for _, x, d in rows:
            found[x] = found.get(x, 0) + (d not in led)
            led.add(d)
        return margins, found

    give_back()
    near = list(hardest(Scorer(chosen, np.ones(len(chosen))))[1])
    chosen += [w for w in dict.fromkeys([*usual[: landmarks // 6], *near[: landmarks // 6]]) if w not in chosen]
    marks = Landmarks(chosen)
    nystroem = nystroem_map(marks)
    low = dict.fromkeys([*usual, *near[:negatives], *data.drawn(share)], 1)
    high = marks.kernels(names) @ nystroem if names else np.zeros((0, nystroem.shape[1]))
    groups = [np.array(of_doc[d]) for d in sorted(of_doc)]
    if not groups:
        return ToxicityModel(chosen, np.zeros(len(chosen)), 0.0, 0.0)
    margins = np.zeros(len(data.docs))
    # a document may hold several insults, and others only one of them: all windows of a document that tell about as much as any window does
    # (not those that clean ones hold too often)
    clear = (strong >= 0.5 * strong.max()) & (rare >= 0.5 * rare.max())
    telling = np.bincount(np.concatenate([g[clear[g]] for g in groups]), minlength=len(held))
    for _ in range(rounds):
        witness = np.array([g[np.lexsort((g, -strong[g]))[0]] for g in groups])
        times = telling + np.bincount(witness, minlength=len(held))
        w, _ = _svm(high[times > 0], times[times > 0].astype(float), marks.kernels(list(low)) @ nystroem, np.array(list(low.values()), dtype=float), penalty)
        margins, harder = hardest(Scorer(chosen, nystroem @ w))
        give_back()
        for x, n in list(harder.items())[:negatives]:
            low[x] = low.get(x, 1) + LEADING * n
        strong = high @ w
    slope, shift = _logistic(margins, data.label.astype(float))
    return ToxicityModel(chosen, nystroem @ w, slope, shift)


def _svm(high: np.ndarray, high_times: np.ndarray, low: np.ndarray, low_times: np.ndarray, penalty: float, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, both classes of equal weight and their rows weighing their times; Newton's method with halved steps."""
    x = np.concatenate([high, low])
    y = np.concatenate([np.ones(len(high)), -np.ones(len(low))])
    s = np.concatenate([0.5 * high_times / high_times.sum(), 0.5 * low_times / low_times.sum()])
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    ridge = np.append(np.full(x.shape[1] - 1, penalty), 1e-9)
    loss = lambda w: float((s * np.maximum(0, 1 - y * (x @ w)) ** 2).sum() + 0.5 * (ridge * w * w).sum())
    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(steps):
        slack = 1 - y * (x @ w)
        on = slack > 0
        own = x[on] * s[on, None]
        step = np.linalg.solve(2 * own.T @ x[on] + np.diag(ridge), ridge * w - 2 * own.T @ (y[on] * slack[on]))
        size = 1.0
        while size > 1e-3 and loss(w - size * step) > now:
            size /= 2
        before, w = now, w - size * step
        now = loss(w)
        if before - now < 1e-9:
            break
    return w[:-1], float(w[-1])


def _logistic(margin: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and shift that turn margins into probabilities; both labels weigh the same."""
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    center, spread = margin.mean(), margin.std() + 1e-9
    x = np.stack([(margin - center) / spread, np.ones(len(margin))], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + np.array([1e-4 * w[0], 0.0])
        h = (x * (weight * np.maximum(p * (1 - p), 1e-3))[:, None]).T @ x + 1e-4 * np.eye(2)
        w = w - 0.5 * np.linalg.solve(h, g)
    slope = max(w[0], 0.0) / spread
    return float(slope), float(w[1] - slope * center)


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, most_docs: int = 2400, sentences_per_doc: int = 200, sentence_chars: int = 500) -> ToxicityModel:
    """Fit on sentences of about ``most_docs`` labelled documents, half of them toxic if there are so many.

    Documents are drawn by hash at rates from their counts. A sentence of over ``sentence_chars`` characters is
    cut into several, and of a document with more than ``sentences_per_doc`` that many are drawn by hash.
    The three parameters bound what reaches the driver; scoring has no bounds. Rows with a null id, text or
    label are not learned from.
    """
    scratch = Scratch(docs.sparkSession, "toxic")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learnable).select(F.col("doc_id").alias("id"), (F.col("toxic") > 0).cast("int").alias("y")).groupBy("id").agg(F.max("y").alias("y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = F.pmod(F.xxhash64(F.lit("toxic"), "id"), F.lit(1 << 20)) / F.lit(1 << 20)
    rate = F.when(F.col("y") == 1, most_docs / 2 / max(1, n.get(1, 0))).otherwise(most_docs / 2 / max(1, n.get(0, 0)))
    drawn = scratch.write(known.where(chance < rate), "drawn")
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("id"))
    cut = F.flatten(F.transform(F.split("text", r"(?<=[.!?])\s+|\n"), lambda s: F.regexp_extract_all(s, F.lit(f"(?s).{{1,{int(sentence_chars)}}}"), F.lit(0))))
    few = F.slice(F.array_sort(F.transform(cut, lambda s: F.struct(F.xxhash64(s).alias("h"), s.alias("s")))), 1, sentences_per_doc)
    got = texts.select(F.col("id").cast("string").alias("id"), "y", F.explode(few).alias("x")).select("id", "y", "x.s").orderBy("id", "s").toPandas()
    code = {i: k for k, i in enumerate(dict.fromkeys(got["id"]))}
    return fit([(code[i], int(y), s) for i, y, s in zip(got["id"], got["y"], got["s"], strict=True)])


def _score(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.landmarks, model.weights)
        for batch in slices(batches, most_bytes=1 << 21):
            margin = scorer.texts(batch.column("text"))
            p = 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(p, pa.float64())], names=["row", "score"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """Score every whole text for toxicity, 0 to 1: the most toxic window of any of its sentences counts.

    Returns ``row`` (a struct of the ``keep`` columns, all by default) and ``score``. Null and empty texts
    get the score of a text without any telling window. Repeated rows and ids are scored one by one. An
    empty table gives no rows.
    """
    make_importable(docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), "text")
    return packed.mapInArrow(_score(model), T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType())]))
