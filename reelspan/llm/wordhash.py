"""Words of whole Arrow batches as 64-bit hashes, by numpy over the batch's bytes."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xC2B2AE3D27D4EB4F | 1
_MASK = (1 << 64) - 1
#: Bytes that are worked on at once.
_PIECE = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self, base: int = _P):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n)
            self.up, self.down = (np.multiply.accumulate(np.array([1] + [b] * self.n, dtype=np.uint64)) for b in (self.base, self.inverse))
        return self.up, self.down


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; null texts are empty."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        kind, wide = np.int64, 8
    else:
        kind, wide = np.int32, 4
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=kind, count=len(texts) + 1, offset=texts.offset * wide).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, off


def pieces(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first text, end text, first byte, end byte): runs of whole short texts, or parts of a long text."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + _PIECE, side="right")) - 1
        if j > i:
            yield i, j, int(off[i]), int(off[j])
            i = j
            continue
        for at in range(int(off[i]), int(off[i + 1]), _PIECE):
            yield i, i + 1, at, min(at + _PIECE, int(off[i + 1]))
        i += 1


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``most_bytes`` of text, a longer text in one of its own, so that what is held per word stays bounded.

    After each batch freed memory goes back to the system: a worker would keep it through later tasks.
    """
    for batch in batches:
        _, off = utf8(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + most_bytes, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end
        give_back()


class Words:
    """Words of a batch: ``hash`` of each, and ``first[i]:first[i + 1]`` are those of text i.

    A word is a run of bytes other than ASCII white space (or other ``separators``, a table of bytes), A-Z lower-cased. Texts are read in pieces of
    ``_PIECE`` bytes; a word that goes on in the next piece is carried there, so words have any length.
    """

    def __init__(self, texts: pa.Array, powers: Powers, spans: bool = False, separators: np.ndarray = SPACE):
        self.raw, self.off = utf8(texts)
        hashes, starts, ends = [], [], []
        held: tuple[int, int, int] | None = None  # sum, length and start of a word that goes on
        for i, j, a, b in pieces(self.raw, self.off):
            if a == b:
                continue
            x = LOWER[self.raw[a:b]]
            inside = ~separators[x]
            edge = np.zeros(b - a + 1, dtype=bool)
            edge[self.off[i:j][(self.off[i:j] >= a) & (self.off[i:j] < b)] - a] = True
            edge[-1] = True
            before = np.concatenate([[False], inside[:-1]])
            s = np.flatnonzero(inside & (~before | edge[:-1]))
            after = np.concatenate([inside[1:], [False]])
            e = np.flatnonzero(inside & (~after | edge[1:])) + 1
            up, down = powers.upto(b - a)
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: b - a], dtype=np.uint64)])
            total, size = (sums[e] - sums[s]) * down[s], e - s
            s, e = s + a, e + a
            if held:
                if len(s) and s[0] == a:
                    total[0] = np.uint64((held[0] + int(total[0]) * pow(powers.base, held[1], 1 << 64)) & _MASK)
                    size[0] += held[1]
                    s[0] = held[2]
                else:
                    total, size = np.insert(total, 0, np.uint64(held[0])), np.insert(size, 0, held[1])
                    s, e = np.insert(s, 0, held[2]), np.insert(e, 0, held[2] + held[1])
                held = None
            if len(e) and e[-1] == b and b < self.off[j]:
                held = int(total[-1]), int(size[-1]), int(s[-1])
                total, size, s, e = total[:-1], size[:-1], s[:-1], e[:-1]
            hashes.append(mix(total + size.astype(np.uint64)))
            starts.append(s)
            ends.append(e)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        self.start = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
        self.first = np.searchsorted(self.start, self.off)
        self.end = np.concatenate(ends) if spans and ends else None

    def text(self, i: int) -> bytes:
        """Word i, A-Z lower-cased."""
        return LOWER[self.raw[self.start[i] : self.end[i]]].tobytes()


def shingles(words: Words, size: int) -> Iterator[np.ndarray]:
    """For every text the sorted distinct hashes of its runs of ``size`` words.

    A text with fewer words has one, its whole sequence; one without words has none.
    """
    h, n = words.hash, len(words.hash)
    q = [np.uint64(pow(_Q, k, 1 << 64)) for k in range(size)]
    all_runs = np.zeros(max(0, n - size + 1), dtype=np.uint64)
    for k in range(size if len(all_runs) else 0):
        all_runs += h[k : n - size + 1 + k] * q[size - 1 - k]
    all_runs = mix(all_runs)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            x = np.sort(all_runs[a : b - size + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif b > a:
            short = np.uint64(b - a)
            for v in h[a:b]:
                short = np.uint64((int(short) * _Q + int(v)) & _MASK)
            yield mix(np.array([short], dtype=np.uint64))
        else:
            yield np.zeros(0, dtype=np.uint64)
