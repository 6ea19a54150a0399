import random

import numpy as np
import pyarrow as pa

from reelspan.llm.decontam import all_matches, allowed_edits, best_match, cgk, find_leaks
from reelspan.llm.wordhash import Powers, Words


def hashes(text):
    return Words(pa.array([text]), Powers()).hash


def semi_global(item, text):
    """Fewest edits between item and any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(r.choices(words, k=r.choice([8, 15, 30, 56])))) for k in range(25)]
    docs = []
    for k in range(150):
        body = r.choices(words, k=r.randrange(5, 200))
        if k % 3 == 0:
            w = r.choice(items)[1].split()
            for _ in range(r.randrange(0, len(w) // 3)):
                at = r.randrange(len(w))
                w[at : at + 1] = r.choice([[], ["new"], [w[at], "more"]])
            at = r.randrange(len(body))
            body[at:at] = w
        docs.append((k, r.choice([" ", "\n"]).join(body).upper()))
    return items, docs


def test_recall_and_precision_against_brute_force(spark):
    items, docs = corpus(1)
    want = set()
    for i, text in docs:
        for k, item in items:
            w = item.split()
            if semi_global(w, text.lower().split()) <= allowed_edits(len(w), 0.2):
                want.add((i, k))
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, item_id string").repartition(3)
    got = find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(x["row"]["doc_id"], x["item_id"]) for x in got}
    assert pairs <= want and len(pairs) >= 0.97 * len(want) and len(want) > 20
    text = dict(docs)
    for x in got:
        w = text[x["row"]["doc_id"]].lower().split()[x["first_word"] : x["first_word"] + x["n_words"]]
        assert semi_global(dict(items)[x["item_id"]].split(), w) <= x["edits"]


def test_best_match_is_the_semi_global_distance():
    r = random.Random(3)
    for _ in range(60):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(1, 12))] for _ in range(2))
        start, end, edits = best_match(hashes(" ".join(a)), hashes(" ".join(b)))
        assert edits == semi_global(a, b) and 0 <= start <= end <= len(b)


def test_cgk_keeps_near_windows_near():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 62, size=(1, 40)).astype(np.uint64)
    y = np.concatenate([x[:, :10], x[:, 11:], x[:, :1]], axis=1)
    far = rng.integers(0, 1 << 62, size=(1, 40)).astype(np.uint64)
    near = [(cgk(x, s, 80) != cgk(y, s, 80)).mean() for s in range(20)]
    assert np.median(near) < 0.4 and np.median([(cgk(x, s, 80) != cgk(far, s, 80)).mean() for s in range(20)]) > 0.9


def test_edges(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, None), (2, ""), (None, item), (4, "x " * 100_000 + item), (5, item[4:]), (6, item), (6, item), (7, "one two"), (8, item + " " + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (None, item), (3, None), (4, "  "), (5, "one")], "item_id long, text string")
    got = [(x["row"]["doc_id"], x["item_id"], x["first_word"], x["n_words"], x["edits"]) for x in find_leaks(docs, bench.where("item_id < 5 or item_id is null")).collect()]
    assert sorted(got, key=str) == sorted([(None, 1, 0, 10, 0), (4, 1, 100_000, 10, 0), (5, 1, 0, 9, 1), (6, 1, 0, 10, 0), (6, 1, 0, 10, 0), (8, 1, 0, 10, 0)], key=str)
    assert (7, 5) in {(x["row"]["doc_id"], x["item_id"]) for x in find_leaks(docs, bench).collect()}
    assert find_leaks(docs, bench.limit(0)).count() == find_leaks(docs.limit(0), bench).count() == 0


def semi_global_apart(item, text, most):
    """Matches by brute force: of all ends the first with the fewest edits, with the start that best_match gives it; then the rest on both sides."""
    best = min(((semi_global_end(item, text[:b]), b) for b in range(1, len(text) + 1)), default=(most + 1, 0))
    edits, b = best
    if edits > most:
        return []
    a, end, _ = best_match(hashes(" ".join(item)), hashes(" ".join(text[:b])))
    assert end == b
    return [*semi_global_apart(item, text[:a], most), (a, b, edits), *((b + x, b + y, e) for x, y, e in semi_global_apart(item, text[b:], most))]


def semi_global_end(item, text):
    """Fewest edits between item and any stretch that ends where text ends."""
    return min(full(item, text[a:]) for a in range(len(text)))


def full(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_all_matches_against_brute_force():
    r = random.Random(4)
    for _ in range(40):
        item = [r.choice("abcd") for _ in range(10)]
        text = []
        for _ in range(4):
            text += [r.choice("abcd") for _ in range(r.randrange(0, 4))] + item[r.randrange(0, 3) : r.randrange(7, 11)]
        got = all_matches(hashes(" ".join(item)), hashes(" ".join(text)), 2)
        assert got == semi_global_apart(item, text, 2)
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))


def test_every_place_is_a_row(spark):
    item = "one two three four five six seven eight nine ten"
    edited = item.replace("four", "quatre").replace("eight", "huit")
    rows = [(1, item + " " + item), (2, " ".join([item] * 1000)), (3, edited + " " + item), (4, item + " x y z " + edited + " " + edited), (5, item)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench, every_place=True).collect()
    got = sorted((x["row"]["doc_id"], x["first_word"], x["n_words"], x["edits"]) for x in found)
    want = [(1, 0, 10, 0), (1, 10, 10, 0), *[(2, 10 * k, 10, 0) for k in range(1000)], (3, 0, 10, 2), (3, 10, 10, 0), (4, 0, 10, 0), (4, 13, 10, 2), (4, 23, 10, 2), (5, 0, 10, 0)]
    assert got == want


def test_long_items(spark):
    """An item of thousands of words, edited here and there, and texts that hold none of it."""
    r = random.Random(8)
    item = [f"w{r.randrange(5000)}" for _ in range(3000)]
    near = [w if r.random() > 0.05 or k in (0, 2999) else "edit" for k, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(["x"] * 50 + near + ["y"] * 70)), (2, " ".join(r.choices(item, k=4000))), (3, " ".join(item[:1500]))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = find_leaks(docs, bench, keep=["doc_id"], every_place=True).collect()
    assert [(x["row"]["doc_id"], x["item_id"], x["first_word"], x["n_words"]) for x in got] == [(1, 7, 50, 3000)]
    assert got[0]["edits"] == sum(a != b for a, b in zip(item, near))
