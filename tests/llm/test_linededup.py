import random
from collections import Counter

from reelspan.llm.linededup import LineRuns, dedup_batch, drop_frequent_lines
from reelspan.llm.scratch import Scratch

WS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, n_lines int, kept string, row string"


def brute(rows, min_docs, min_chars):
    def key(x):
        return x.strip(WS).encode().lower().decode()

    df = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or df[key(x)] < min_docs]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def table(seed):
    r = random.Random(seed)
    pool = ["Common line", " common LINE\r", "É line", "é line", " x", "x", "", "  \t", "rare %d"]
    rows = [(k, "\n".join(p if "%d" not in p else p % r.randrange(40) for p in r.choices(pool, k=r.randrange(1, 9)))) for k in range(120)]
    return rows + [(5, None), (5, None), (None, "Common line\nmine"), (200, ""), (201, "\n\n"), (202, "y\n" * 50000)]


def test_both_ways_match_brute_force(spark):
    rows = table(1)
    df = spark.createDataFrame([(i, t, 0, "k", "r") for i, t in rows], SCHEMA).repartition(3)
    for most in (1 << 20, 0):
        got = drop_frequent_lines(df, 10, 1, most_broadcast=most).selectExpr("row.doc_id", "kept", "n_lines", "n_dropped").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, 10, 1)
    assert drop_frequent_lines(df.limit(0)).count() == 0


def test_batches_keep_first(spark):
    runs = LineRuns(Scratch(spark, "t"))
    seen, r = set(), random.Random(4)
    for b in range(5):
        rows = [(10 * b + k, "\n".join(r.choice(["a", "B", "c %d" % r.randrange(30), ""]) for _ in range(5))) for k in range(8)]
        got = dict(map(tuple, dedup_batch(spark.createDataFrame(rows, "doc_id long, text string"), runs).collect()))
        want = {i: "\n".join(x for x in t.split("\n") if not x or x.lower() not in seen) for i, t in rows}
        assert got == want
        seen |= {x.lower() for _, t in rows for x in t.split("\n")}
    assert len(runs.runs()) <= 4


def test_settled_keys_are_counted_no_more(spark):
    """The anti-join decides: what has enough documents leaves the levels and is not added again."""
    scratch = Scratch(spark, "t")
    runs = LineRuns(scratch, enough=3, fanout=2, holders=True)
    batch = lambda b: spark.createDataFrame([(1, 1, 2, 10 * b), (2, 2, 1, 10 * b + 1), (100 + b, 0, 1, 10 * b + 2)], "h1 long, h2 long, n long, holder long")
    for b in range(8):
        runs.add(batch(b))
        left = [r["h1"] for level in runs.levels for run in level for r in run.collect()]
        assert left.count(1) == (1 if b == 0 else 0) and (b < 3 or left.count(2) == 0)
    assert sorted(map(tuple, runs.frequent().collect())) == [(1, 1, 0), (2, 2, 1)]
    assert sorted(r["h1"] for r in runs.levels[-1][0].collect()) == [100 + b for b in range(8)]
    files = runs.levels[-1][0].inputFiles()
    assert all([x for x in (tuple(r) for r in spark.read.parquet(f).select("h1", "h2").collect())] == sorted(tuple(r) for r in spark.read.parquet(f).select("h1", "h2").collect()) for f in files)


def test_settled_keys_reach_no_aggregate(spark):
    """Whatever is added as lines, a settled key is gone before a batch is counted, and what tasks hold is bounded."""
    seen = []

    class Watched(LineRuns):
        def add(self, counts, compact=True):
            seen.append({r["h1"]: r["n"] for r in counts.collect()})
            super().add(counts, compact)

    rows = lambda b: [(1, 1)] * 4 + [(2, 2)] * 2 + [(100 + b, 0)]
    for most in (1 << 20, 1, 0):
        seen.clear()
        runs = Watched(Scratch(spark, "t"), enough=3, fanout=2, most_held=most)
        for b in range(6):
            runs.add_lines(spark.createDataFrame(rows(b), "h1 long, h2 long"))
            assert runs.held() is None or runs.held().count() <= most
        assert [s[100 + b] for b, s in enumerate(seen)] == [1] * 6
        if most:
            assert all(1 in s for s in seen[:2]) and not any(1 in s for s in seen[2:])
        if most > 1:
            assert not any(2 in s for s in seen[2:])
        assert sorted(r["h1"] for r in runs.frequent().collect()) == [1, 2]


def test_both_ways_agree_with_many_frequent_lines(spark):
    docs = spark.createDataFrame([(k, "\n".join(f"line {j}" for j in range(3000)) + f"\nown {k}") for k in range(12)], "doc_id long, text string")
    for most in (1 << 20, 0):
        got = drop_frequent_lines(docs, 10, 1, most_broadcast=most).selectExpr("row.doc_id", "kept", "n_lines", "n_dropped").collect()
        assert sorted(map(tuple, got)) == [(k, f"own {k}", 3001, 3000) for k in range(12)]


def test_sql_agrees_on_repeated_ids(spark):
    import duckdb

    from reelspan.llm.linededup import LINES_SQL

    docs = spark.createDataFrame([(i, t) for i, t in table(7)], "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(LINES_SQL).fetchall()
    got = drop_frequent_lines(docs, 10, 1).selectExpr("row.doc_id", "n_lines", "n_dropped", "sha2(cast(kept as binary), 256)").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_batches_of_nulls_and_repeats(spark):
    runs = LineRuns(Scratch(spark, "t"))
    first = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (None, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, dedup_batch(first, runs).collect()), key=str) == sorted([(1, "a\nb"), (None, ""), (2, "")], key=str)
    again = spark.createDataFrame([(1, "A \nc"), (None, "b"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, dedup_batch(again, runs).collect()), key=str) == sorted([(1, "c"), (None, ""), (3, "")], key=str)
    assert dedup_batch(first.limit(0), runs).count() == 0


def test_keep_one_leaves_each_frequent_line_with_its_smallest_holder(spark):
    rows = [x for x in table(4) if x[0] != 5] + [(1000, "Common line\nother"), (1000, "common line"), (None, "rare null")] + [(k, "only nulls") for k in [None] * 12]
    key = lambda x: x.strip(WS).encode().lower().decode()
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    count = Counter(k for _, t in rows for k in {key(x) for x in t.split("\n")})
    smallest = {k: min((i is None, i or 0) for i, t in rows if k in {key(x) for x in t.split("\n")}) for k in count}
    want = sorted(((i, "\n".join(x for x in t.split("\n") if not key(x) or count[key(x)] < 10 or smallest[key(x)] == (i is None, i or 0))) for i, t in rows), key=str)
    for most in (1 << 20, 0):
        assert sorted(((x["row"]["doc_id"], x["kept"]) for x in drop_frequent_lines(docs, 10, 1, most_broadcast=most, keep_one=True).collect()), key=str) == want


def test_pipeline_keeps_one_of_every_group_of_copies(spark):
    import corpus_pipeline as p

    word = lambda k: f"w{k * 7919 % 10007}"
    text = lambda g: "\n".join(" ".join(word(g * 1000 + 20 * line + k) for k in range(12)) for line in range(4))
    rows = [(100 * g + k, text(g), "en", "web", 0) for g, size in enumerate([1, 9, 10, 12, 40]) for k in range(size)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = p.near_duplicates(spark, p.Scratch(spark, "test").write(p.line_dedup(spark, docs, ""), "lines"), "").collect()
    assert {(x["doc_id"], x["text"]) for x in kept} == {(100 * g, text(g)) for g in range(5)}
