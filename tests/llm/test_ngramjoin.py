import random

from reelspan.llm import ngramjoin
from reelspan.llm.components import connected_components
from reelspan.llm.ngramjoin import jaccard_components
from reelspan.llm.scratch import Scratch


def grams(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["É", "ß", "x|y"]
    passage = " ".join(r.choices(words, k=30))
    rows = []
    for b in range(n):
        base = r.choices(words, k=r.choice([3, 5, 8, 40, 120]))
        for _ in range(r.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append("\n".join([" ".join(w), passage]) if b % 3 == 0 else " ".join(w).upper())
    base = r.choices(words, k=100)
    for _ in range(120):
        w = list(base)
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        rows.append(" ".join(w))
    rows += [None, "", "  \t", "one", "ONE", "a b c d", rows[0], rows[0]]
    ids = list(range(len(rows)))
    r.shuffle(ids)
    return [(i, t) for i, t in zip(ids, rows)] + [(ids[0], "twice the same id here and more"), (None, rows[0]), (None, "nobody names this text at all"), (None, None)]


def test_matches_brute_force(spark):
    for seed, tile in ((1, 256), (2, 16)):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, node int, comp string").repartition(3)
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, tile=tile).collect()), key=str)
        assert got == brute(rows)


def test_what_one_fragment_tells_apart_is_not_dealt_whole(spark, monkeypatch):
    """Groups of six texts that share a third of their words, none of them linked: one fragment of most sets goes to a tile, once."""
    r = random.Random(7)
    passages = [" ".join(f"p{g}_{k}" for k in range(100)) for g in range(10)]
    rows = [(k, passages[k % 10] + " " + " ".join(f"w{r.randrange(10**9)}" for _ in range(200))) for k in range(60)]
    dealt = []
    together = ngramjoin._together
    monkeypatch.setattr(ngramjoin, "_together", lambda df: dealt.append(df.count()) or together(df))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(k, 296, k) for k in range(60)]
    assert 0 < sum(dealt) < 2 * len(rows)  # whole sets, in both phases, would be eight times the rows


def test_empty_and_long(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(df).count() == 0
    text = " ".join(str(k) for k in range(300_000))
    df = spark.createDataFrame([(2, text), (1, text + " end"), (3, "x" * 3_000_000)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(df).collect())) == [(1, 299_997, 1), (2, 299_996, 1), (3, 1, 3)]


def test_components(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(500 + k, 499) for k in range(50)] + [(7, 7), (3, 900), (900, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()))
    assert all(got[k] == 100 for k in range(100, 161)) and all(got[k] == 499 for k in range(499, 550)) and got[900] == 3 and 7 not in got


def test_runs_of_any_length_are_one_word(spark):
    run = "x" * 12_000_000
    df = spark.createDataFrame([(1, run), (2, run + " "), (3, "y" * 1_200_000), (4, " ".join(["a", "b", "c", "d", run]))], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(df).collect())) == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 4)]
