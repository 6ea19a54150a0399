"""License scans: exact phrases, and fuzzy short notices found by shared trigrams and pigeonhole seeds and verified with bounded-error matching."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import make_importable
from .wordhash import slices

# Phrases that count wherever their words stand in a row, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Short notices and their labels. A notice may have one error in eight characters.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution 4 0": "cc-by",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2 0": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "redistributions of source code must retain the above copyright notice": "bsd",
    "this program is free software you can redistribute it and or modify it": "gpl",
    "distributed under the boost software license version 1 0": "bsl-1",
    "subject to the terms of the mozilla public license": "mpl-2",
    "eclipse public license version 2 0": "epl-2",
    "european union public licence": "eupl",
    "creative commons zero v1 0 universal": "cc0",
    "do what the fuck you want to public license": "wtfpl",
    "sil open font license version 1 1": "ofl",
}
ERROR_RATE = 8

_WORD = np.ones(256, dtype=bool)
_WORD[:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False
#: Bytes of lower-cased text, those outside words as spaces.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if (_WORD[c] or 65 <= c <= 90) else 32 for c in range(256))


def normalise(text: str | None) -> bytes:
    """Words of a text with one space before, between and after (one space if there are none); words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return b" ".join([b"", *(text or "").encode().translate(_TABLE).split(), b""])


@dataclass
class Notice:
    words: bytes
    label: str
    errors: int
    seeds: list[tuple[bytes, int]]
    #: For up to 0, 1, ... errors.
    patterns: list[regex.Pattern]


def compile_notices(notices: dict[str, str], rate: int = ERROR_RATE) -> list[Notice]:
    """A notice with at most e errors holds one of e + 1 equal pieces unchanged: those are its seeds, with their place in it."""
    out = []
    for words, label in notices.items():
        w = words.encode()
        errors = len(w) // rate
        cuts = [len(w) * k // (errors + 1) for k in range(errors + 2)]
        seeds = [(w[a:b], a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        patterns = [regex.compile(rb"(?b)(?:" + regex.escape(w) + rb"){e<=%d}" % e) for e in range(errors + 1)]
        out.append(Notice(w, label, errors, seeds, patterns))
    return out


#: Five bits for a byte of normalised text: letters apart, digits as one kind, characters beyond ASCII as another.
_KIND = np.full(256, 28, dtype=np.uint16)
_KIND[ord(" ")], _KIND[ord("0") : ord("9") + 1], _KIND[ord("a") : ord("z") + 1] = 26, 27, range(26)


def trigrams(text: bytes) -> np.ndarray:
    """15 bits for each run of three bytes; equal runs have equal bits."""
    kinds = _KIND[np.frombuffer(text, dtype=np.uint8)]
    return (kinds[:-2] << 10) | (kinds[1:-1] << 5) | kinds[2:]


def likely(texts: list[bytes], notices: list[Notice]) -> list[list[Notice]]:
    """For each normalised text the notices that it may hold, none of those it holds being left out.

    An error changes three of a notice's trigrams at most, so with e errors all but 3 e of them stand in the
    match, which is e longer than the notice at most. Trigrams of a stretch of that length are counted.
    """
    out: list[list[Notice]] = [[] for _ in texts]
    joined = b"".join(texts)
    if len(joined) < 3:
        return [list(notices) for _ in texts]
    first = np.cumsum([0, *map(len, texts)])
    grams = trigrams(joined)
    for n in notices:
        need, reach = len(n.words) - 2 - 3 * n.errors, len(n.words) + n.errors - 2
        if need <= 0:
            for x in out:
                x.append(n)
            continue
        own = np.zeros(1 << 15, dtype=np.int32)
        own[trigrams(n.words)] = 1
        before = np.zeros(len(grams) + 1, dtype=np.int32)
        np.cumsum(own[grams], out=before[1:])
        reach = min(reach, len(grams))
        at = np.flatnonzero(before[reach:] - before[:-reach] >= need)
        # a stretch may begin in one text and hold a match in the next ones
        reached = np.zeros(len(texts) + 1, dtype=np.int64)
        np.add.at(reached, np.searchsorted(first, at, side="right") - 1, 1)
        np.add.at(reached, np.minimum(np.searchsorted(first, at + reach + 2, side="left"), len(texts)), -1)
        for k in np.flatnonzero(np.cumsum(reached)[:-1] > 0):
            out[k].append(n)
    return out


def distances(text: bytes, words: bytes) -> np.ndarray:
    """For each place of ``text`` the errors of the best match of ``words`` that ends there."""
    letters, place = np.frombuffer(text, dtype=np.uint8), np.arange(len(text) + 1, dtype=np.int32)
    row, new = np.zeros(len(text) + 1, dtype=np.int32), np.empty(len(text) + 1, dtype=np.int32)
    for i, c in enumerate(words, 1):
        new[0] = i
        np.minimum(row[:-1] + (letters != c), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - place) + place
    return row


def find_all(text: bytes, piece: bytes, overlap: bool = True) -> Iterator[int]:
    at = text.find(piece)
    while at >= 0:
        yield at
        at = text.find(piece, at + (1 if overlap else len(piece)))


def fuzzy_spans(text: bytes, notice: Notice) -> list[tuple[int, int, int]]:
    """(start, end, errors) of all matches of the notice around exact seeds that don't overlap, best first; ``text`` is normalised."""
    slack, size = notice.errors, len(notice.words)
    regions: list[list[int]] = []
    for start in sorted(at - offset for piece, offset in notice.seeds for at in find_all(text, piece)):
        a, b = max(0, start - slack), start + size + slack
        if regions and a <= regions[-1][1]:
            regions[-1][1] = max(b, regions[-1][1])
        else:
            regions.append([a, b])
    found = []
    for a, b in regions:
        found += [(a + x, a + y, errors) for x, y, errors in _apart(text[a:b], notice)]
    return found


def _apart(text: bytes, notice: Notice) -> list[tuple[int, int, int]]:
    """Matches in ``text``, none overlapping, the best taken first and of equals the first one; then again before and after it."""
    words, most = notice.words, notice.errors
    ends = distances(text, words)
    starts, stops, found = [], [], []
    for errors in range(most + 1) if ends.min() <= most else ():
        for end in np.flatnonzero(ends == errors).tolist():
            if ends[end] != errors:
                continue
            k = bisect.bisect_right(stops, end)
            low = max(end - len(words) - errors, stops[k - 1] if k else 0)
            m = notice.patterns[errors].search(text, low, end)
            a, b = m.span()
            starts.insert(k, a)
            stops.insert(k, b)
            found.append((a, b, errors))
            # ends inside the match are gone, and those soon after it must do without its characters
            ends[a + 1 : b + 1] = len(words)
            reach = min(b + len(words) + most, len(text), starts[k + 1] if k + 1 < len(starts) else len(text))
            ends[b + 1 : reach + 1] = distances(text[b:reach], words)[1:]
    return sorted(found)


def scan_text(text: str | None, phrases: list[tuple[bytes, str]], notices: list[Notice]) -> dict:
    words = normalise(text)
    return scan_words(words, phrases, likely([words], notices)[0])


def scan_words(words: bytes, phrases: list[tuple[bytes, str]], notices: list[Notice]) -> dict:
    """Phrases, and those of ``notices`` that are there, in a normalised text."""
    n_words = words.count(b" ") - 1
    base = sorted((words.count(b" ", 0, at + 1) - 1, label, at) for phrase, label in phrases for at in find_all(words, b" " + phrase + b" "))
    spans, labels, score = [], {label for _, label, _ in base}, 1.0 if base else 0.0
    starts = None
    for n in notices:
        for a, b, errors in fuzzy_spans(words, n):
            if starts is None:
                starts = [0, *(k for k, c in enumerate(words) if c == 32)]
            labels.add(n.label)
            sure = 1.0 - errors / len(n.words)
            score = max(score, sure)
            spans.append({"label": n.label, "first_word": max(0, bisect.bisect_right(starts, a) - 2), "last_word": max(0, bisect.bisect_left(starts, b - 1) - 2), "errors": errors})
    return {
        "n_words": n_words,
        "n_base": len(base),
        "first_word": base[0][0] if base else None,
        "last_word": base[-1][0] if base else None,
        "base_labels": ",".join(sorted({label for _, label, _ in base})),
        "labels": ",".join(sorted(labels)),
        "score": score,
        "spans": sorted(spans, key=lambda s: (s["first_word"], s["last_word"], s["label"])),
    }


def _parts(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of ``most`` bytes together, or one text."""
    a, held = 0, 0
    for k, t in enumerate(texts):
        if k > a and held + len(t) > most:
            yield a, k
            a, held = k, 0
        held += len(t)
    if texts:
        yield a, len(texts)


_SPAN = T.StructType([T.StructField("label", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("first_word", "last_word", "errors")]])
_FOUND = [
    *[T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")],
    *[T.StructField(c, T.StringType()) for c in ("base_labels", "labels")],
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(_SPAN)),
]
_NAMES = [f.name for f in _FOUND]


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, error_rate: int = ERROR_RATE, keep: list[str] | None = None) -> DataFrame:
    """Find licence phrases and short notices in whole texts.

    ``phrases`` count where their words stand in a row. ``notices`` may have one error (a character more,
    less or other) in ``error_rate`` characters: texts with too few of its trigrams near each other are left out
    (an exact bound), seeds of e + 1 pieces locate candidates, the regex library verifies them and gives the span
    and its errors. A notice is read on the words only, so punctuation and
    line ends don't matter.

    Returns ``row`` (a struct of the ``keep`` columns, all by default), n_words, n_base (places of phrases),
    first_word and last_word (smallest and largest start of those, else null), base_labels, labels (also the
    notices'; both distinct, sorted, comma-joined), score (1 for a phrase, else 1 less the share of errors of
    the best notice, else 0) and spans of notices. Null and empty texts have no words. Repeated rows and
    ids are scanned one by one. An empty table gives no rows.
    """
    make_importable(docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), "text")
    kind = T.StructType([packed.schema["row"], *_FOUND])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, fuzzy = [(p.encode(), label) for p, label in phrases.items()], compile_notices(notices, error_rate)
        types = {"score": pa.float64(), "base_labels": pa.string(), "labels": pa.string(), "spans": pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int64())]))}
        for batch in slices(batches):
            words = [normalise(t) for t in batch.column("text").to_pylist()]
            found = []
            for a, b in _parts(words, 1 << 17):
                found += [scan_words(w, exact, n) for w, n in zip(words[a:b], likely(words[a:b], fuzzy), strict=True)]
            columns = [pa.array([f[name] for f in found], types.get(name, pa.int64())) for name in _NAMES]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], names=["row", *_NAMES])

    return packed.mapInArrow(run, kind)
