"""Benchmark decontamination by CGK embedding, bit-sampling LSH over item-sized windows, and exact edit verification."""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .langid import _cuts
from .scratch import make_importable
from .wordhash import Powers, Words, mix, slices

#: Items, and bytes of them, that are held by every task at once; more go in further passes.
ITEMS_AT_ONCE, BYTES_AT_ONCE = 1 << 13, 1 << 24
#: Words of all windows that are embedded at once.
CELLS = 1 << 20
_PAD = np.uint64(0x70AD)


def allowed_edits(words: int, rate: float) -> int:
    return int(words * rate)


def word_grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of ``size`` words."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return out


def gram_rule(words: int, edits: int) -> tuple[int, int]:
    """(size, need): of an item's runs of ``size`` words at least ``need`` outlast the edits, each of which changes ``size`` runs at most."""
    return next((q, words - q + 1 - q * edits) for q in (3, 2, 1) if words - q + 1 - q * edits > 0)


def cgk(windows: np.ndarray, seed: int, steps: int) -> np.ndarray:
    """The first ``steps`` symbols of the CGK embeddings (Chakraborty, Goldenberg and Koucký, 2016) of equally long word windows, one row each.

    Walk over a window; a random bit of the step and the word says whether to go on to the next word. Two
    windows a few edits apart are few symbols apart after the walk.
    """
    n, m = windows.shape
    padded = np.concatenate([windows, np.full((n, 1), _PAD)], axis=1)
    at, rows = np.zeros(n, dtype=np.int64), np.arange(n)
    out = np.empty((n, steps), dtype=np.uint64)
    for step in range(steps):
        x = padded[rows, at]
        out[:, step] = x
        coin = mix(x ^ np.uint64((seed * 0x9E3779B1 + step * 0x85EBCA77) & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)
        at = np.minimum(at + coin.astype(np.int64), m)
    return out


class Index:
    """LSH tables of a block of items: for every length, walk and table, keys of sampled places of the embedding.

    With ``walks`` walks of ``tables`` tables of ``places`` places, an item whose embedding is a share d of
    symbols away is met with probability 1 - (1 - (1 - d)^places)^(walks * tables), which is over 0.98 up to
    d = 0.5 for the defaults. Places are drawn from twice the item's length: most walks have ended after that.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], rate: float, walks: int = 8, tables: int = 8, places: int = 4):
        self.items, self.rate, self.walks = items, rate, walks
        rng = np.random.default_rng(11)
        self.by_length: dict[int, list[int]] = defaultdict(list)
        for k, (_, h) in enumerate(items):
            if len(h):
                self.by_length[len(h)].append(k)
        self.rules = {m: gram_rule(m, allowed_edits(m, rate)) for m in self.by_length}
        self.bits = 20
        self.own_grams: dict[int, np.ndarray] = {}
        self.grams: dict[int, np.ndarray] = {}
        self.seen: dict[int, np.ndarray] = {}
        for q in {q for q, _ in self.rules.values()}:
            for m, ks in self.by_length.items():
                if self.rules[m][0] == q:
                    self.own_grams[m] = np.unique(np.concatenate([word_grams(items[k][1], q) for k in ks]))
            self.grams[q] = np.unique(np.concatenate([g for m, g in self.own_grams.items() if self.rules[m][0] == q]))
            self.seen[q] = np.zeros(1 << self.bits, dtype=bool)
            self.seen[q][self._slot(self.grams[q])] = True
        self.sampled: dict[int, np.ndarray] = {}
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for m, own in self.by_length.items():
            self.sampled[m] = np.stack([np.sort(rng.choice(2 * m, size=min(places, 2 * m), replace=False)) for _ in range(tables)])
            self.tables[m] = []
            for keys in self._keys(np.stack([items[k][1] for k in own]), m):
                order = np.argsort(keys, kind="stable")
                self.tables[m].append((keys[order], np.array(own)[order]))

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (mix(h) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _keys(self, windows: np.ndarray, m: int) -> Iterator[np.ndarray]:
        for walk in range(self.walks):
            embedded = cgk(windows, walk, 2 * m)
            for places in self.sampled[m]:
                key = np.zeros(len(windows), dtype=np.uint64)
                for p in places:
                    key = mix(key * np.uint64(31) + embedded[:, p])
                yield key

    def has_gram(self, h: np.ndarray, size: int) -> np.ndarray:
        """Whether a run of words stands in some item of that rule."""
        out = self.seen[size][self._slot(h)]
        hit = np.flatnonzero(out)
        out[hit] = np.isin(h[hit], self.grams[size])
        return out

    def candidates(self, hash: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """(text, item) to the starts of the windows that met the item, for texts whose words are ``hash[first[i]:first[i + 1]]``.

        Windows of an item's length start at every word. Those that cannot hold the item within its edits are
        left out before the walks: too few of its runs of words stand in the window and its margin.
        """
        found: dict[tuple[int, int], list[int]] = defaultdict(list)
        n = len(hash)
        if not n:
            return found
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        end = first[1:][text]
        hits = {}
        for q in self.grams:
            grams = word_grams(hash, q)
            at = np.flatnonzero(self.has_gram(grams, q))
            at = at[at + q <= end[at]]
            hits[q] = at, grams[at]
        for m in self.by_length:
            k = allowed_edits(m, self.rate)
            q, need = self.rules[m]
            at, grams = hits[q]
            at = at[np.isin(grams, self.own_grams[m])]
            one, other = at[: max(0, len(at) - need + 1)], at[need - 1 :]
            low, high = np.maximum(other + q - m - k, first[text[one]]), np.minimum(one, end[one] - (m - k))
            near = (text[one] == text[other]) & (low <= high)
            sizes = (high - low + 1)[near]
            starts = np.unique(np.repeat(low[near] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()))
            for part in np.array_split(starts, max(1, -(-len(starts) * m // CELLS))):
                place = part[:, None] + np.arange(m)
                windows = np.where(place < end[part][:, None], hash[np.minimum(place, n - 1)], _PAD)
                for keys, (known, items) in zip(self._keys(windows, m) if len(part) else (), self.tables[m], strict=False):
                    lo, hi = np.searchsorted(known, keys, side="left"), np.searchsorted(known, keys, side="right")
                    for w in np.flatnonzero(hi > lo):
                        for item in items[lo[w] : hi[w]]:
                            found[int(text[part[w]]), int(item)].append(int(part[w] - first[text[part[w]]]))
        return found

    def verify(self, words: np.ndarray, item: int, starts: list[int]) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the best match around each run of neighbouring starts, where it has few enough edits."""
        h = self.items[item][1]
        k = allowed_edits(len(h), self.rate)
        out, starts = [], sorted(set(starts))
        runs = np.split(np.array(starts), np.flatnonzero(np.diff(starts) > len(h)) + 1)
        for run in runs:
            a, b = max(0, int(run[0]) - k), min(len(words), int(run[-1]) + len(h) + k)
            start, end, edits = best_match(h, words[a:b])
            if edits <= k and end > start:
                out.append((a + start, a + end, edits))
        return out

    def verify_all(self, words: np.ndarray, item: int, starts: list[int]) -> list[tuple[int, int, int]]:
        """(start, end, edits) of all matches around the starts that have few enough edits and don't overlap."""
        h = self.items[item][1]
        k = allowed_edits(len(h), self.rate)
        out, starts = [], sorted(set(starts))
        for run in np.split(np.array(starts), np.flatnonzero(np.diff(starts) > len(h) + 2 * k) + 1):
            a, b = max(0, int(run[0]) - k), min(len(words), int(run[-1]) + len(h) + k)
            out += [(a + start, a + end, edits) for start, end, edits in all_matches(h, words[a:b], k)]
        return out


def distances(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each place of ``text`` the word edits of the best match of ``item`` that ends there."""
    place = np.arange(len(text) + 1)
    row, new = np.zeros(len(text) + 1, dtype=np.int64), np.empty(len(text) + 1, dtype=np.int64)
    for i, x in enumerate(item.tolist(), 1):
        new[0] = i
        np.minimum(row[:-1] + (text != np.uint64(x)), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - place) + place
    return row


def all_matches(item: np.ndarray, text: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """Stretches of ``text`` with up to ``most`` edits, none overlapping: the best first, of equals the first one, then again before and after it."""
    ends = distances(item, text)
    starts, stops, found = [], [], []
    for edits in range(most + 1):
        for end in np.flatnonzero(ends == edits).tolist():
            if ends[end] != edits:
                continue
            k = bisect.bisect_right(stops, end)
            low = max(end - len(item) - edits, stops[k - 1] if k else 0)
            a, b, _ = best_match(item, text[low:end])
            a, b = low + a, low + b
            starts.insert(k, a)
            stops.insert(k, b)
            found.append((a, b, edits))
            # ends inside the match are gone, and those soon after it must do without its words
            ends[a + 1 : b + 1] = most + 1
            reach = min(b + len(item) + most, len(text), starts[k + 1] if k + 1 < len(starts) else len(text))
            ends[b + 1 : reach + 1] = distances(item, text[b:reach])[1:]
    return sorted(found)


def lengths(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Word edits between ``item`` and the last j words of ``text``, for each j."""
    text = text[::-1]
    place = np.arange(len(text) + 1)
    row, new = place.copy(), np.empty(len(text) + 1, dtype=np.int64)
    for i, x in enumerate(item[::-1].tolist(), 1):
        new[0] = i
        np.minimum(row[:-1] + (text != np.uint64(x)), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - place) + place
    return row


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """The stretch of ``text`` with the fewest word edits to ``item``; the first to end and of these the shortest: (start, end, edits)."""
    ends = distances(item, text)
    end = int(ends.argmin())
    edits = int(ends[end])
    near = text[max(0, end - len(item) - edits) : end]
    return end - int(lengths(item, near).argmin()), end, edits


@lru_cache(maxsize=1)
def _index(listed: tuple[tuple[int, str], ...], rate: float) -> Index:
    """The index of a block of items, built once by each worker and not for each of its tasks."""
    words = Words(pa.array([t for _, t in listed], pa.string()), Powers())
    return Index([(i, words.hash[a:b]) for (i, _), a, b in zip(listed, words.first[:-1], words.first[1:], strict=True)], rate)


def _search(index_of: list[tuple[int, str]], rate: float, every_place: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        index = _index(tuple(index_of), rate)
        items = index.items
        verify = index.verify_all if every_place else index.verify
        for batch in slices(batches, most_bytes=1 << 22):
            words = Words(batch.column("text"), powers)
            found: list[list] = [[], [], [], [], []]
            cuts = _cuts(words.first, 1 << 21)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                lo, hi = words.first[a], words.first[b]
                for (k, item), starts in sorted(index.candidates(words.hash[lo:hi], words.first[a : b + 1] - lo).items()):
                    h = words.hash[words.first[a + k] : words.first[a + k + 1]]
                    for start, end, edits in verify(h, item, starts):
                        for column, value in zip(found, (a + k, items[item][0], start, end - start, edits), strict=True):
                            column.append(value)
            rows = batch.column("row").take(pa.array(found[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, *[pa.array(c, pa.int64()) for c in found[1:]]], names=["row", "item_id", "first_word", "n_words", "edits"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, edit_rate: float = 0.2, keep: list[str] | None = None, every_place: bool = False) -> DataFrame:
    """Places in whole texts that hold a benchmark item with at most ``edit_rate`` of its words edited.

    Words are runs of characters other than ASCII white space, A-Z lower-cased. Every window of an item's
    length is embedded by CGK walks, so that word edits become differing symbols; bit-sampling LSH tables
    over the embedding give candidate items, and the exact word edit distance of the item to the best
    stretch around them decides. Items are read in blocks of about ``ITEMS_AT_ONCE`` and ``BYTES_AT_ONCE``, one pass each.

    Returns ``row`` (a struct of the documents' ``keep`` columns, all by default), item_id, first_word and
    n_words (the matched stretch) and edits. With ``every_place`` there is one row per place, the best of
    overlapping ones; otherwise places at most an item's length apart give one row, the best of them. Null and empty texts and items match
    nothing; items without an id are left out; texts shorter than an item match it if the missing words are
    within its edits. Repeated rows, ids and items are searched one by one. Empty tables give no rows.
    """
    make_importable(docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), "text")
    kind = T.StructType([packed.schema["row"], *[T.StructField(c, T.LongType()) for c in ("item_id", "first_word", "n_words", "edits")]])
    usable = benchmark.where("item_id is not null and length(trim(text)) > 0").select("item_id", "text")
    n, size = usable.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, -(-n // ITEMS_AT_ONCE), -(-size // BYTES_AT_ONCE))
    out = None
    for k in range(passes):
        part = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else usable
        items = sorted((r["item_id"], r["text"]) for r in part.collect())
        found = packed.mapInArrow(_search(items, edit_rate, every_place), kind)
        out = found if out is None else out.unionByName(found)
    return out
