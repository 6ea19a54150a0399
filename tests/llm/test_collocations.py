import random
import re
from collections import Counter

import numpy as np
import pytest

from reelspan.llm.collocations import collocations, tile_counts


def brute(rows, longest=3, min_count=10, percent=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    out = []
    for (lang, p), a in cands.items():
        if any(
            g == lang and len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q)))
            for (g, q), b in cands.items()
        ):
            continue
        score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    result, place = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            result.append((lang, place[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(result)


def corpus(seed, n=400):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["É", "ß𝄞", "X-1", "'"]
    idioms = [" ".join(r.choices(words, k=k)) for k in (2, 3, 3, 4)]
    rows = []
    for _ in range(n):
        parts = [r.choice(idioms) if r.random() < 0.2 else r.choice(words) for _ in range(r.randrange(0, 60))]
        rows.append(("".join(p + r.choice([" ", " ", " ", "\t", ". ", "\n", "  ", "\xa0"]) for p in parts), r.choice(["a", "b", "b", None])))
    return [*rows, (None, "a"), ("", None), ("  .. ", "b"), ("a a a a a a a a a a a a a", "rep"), ("LOUD Words " * 20, "rep")]


def table(spark, rows):
    return spark.createDataFrame([(k, *x, 1, "s") for k, x in enumerate(rows)], "doc_id long, text string, lang string, n int, score string")


@pytest.mark.parametrize(("ranked", "longest"), [(1 << 17, 3), (20, 3), (0, 4)])
def test_equals_brute_force(spark, ranked, longest):
    rows = corpus(longest)
    got = collocations(table(spark, rows).repartition(3), longest=longest, most_ranked=ranked)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, longest)


def test_top_and_counts(spark):
    rows = corpus(9)
    got = collocations(table(spark, rows), min_count=3, percent=80, top=7)
    assert sorted(map(tuple, got.collect())) == brute(rows, min_count=3, percent=80, top=7)


def test_empty_and_long(spark):
    assert collocations(table(spark, [])).count() == 0
    assert collocations(table(spark, [(None, None), ("", "a")])).count() == 0
    text = "one two " * 400_000
    got = [tuple(r) for r in collocations(table(spark, [(text, "a"), ("x" * 3_000_000, "a")])).collect()]
    assert got == brute([(text, "a")])[:0] + [("a", *r[1:6], 800_001, r[7]) for r in brute([(text, "a")])]


def test_tiles_are_counts_of_pairs():
    rng = np.random.default_rng(2)
    left = np.concatenate([rng.integers(0, 40, 200_000), rng.integers(0, 3000, 50_000), [0, 2999]])
    right = np.concatenate([rng.integers(500, 530, 200_000), rng.integers(0, 70_000, 50_000), [69_999, 0]])
    a, b, n = tile_counts(left, right)
    assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == Counter(zip(left.tolist(), right.tolist()))
    assert len(n) == len(set(zip(a.tolist(), b.tolist())))
