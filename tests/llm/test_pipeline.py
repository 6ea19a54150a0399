"""Stages of the corpus pipeline against loops, and their edge cases."""

import re

import pytest

import corpus_pipeline as p
from reelspan.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or ""), "clash", "clash") for i, t in rows], SCHEMA).repartition(3)


def words(k, n=40):
    return " ".join(f"w{(k * 1000 + j) * 7919 % 100003}" for j in range(n))


def kept(df):
    assert df.columns == p.COLUMNS
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_near_duplicates_of_repeated_and_null_ids(spark):
    near = words(1) + " end"
    rows = [(1, words(1)), (2, near), (2, words(2)), (3, words(2)), (3, words(3)), (3, words(3)), (None, words(3)), (None, words(4)), (None, words(4)), (7, None), (8, None), (8, None), (9, "")]
    got = kept(p.near_duplicates(spark, docs_of(spark, rows), ""))
    want = [(1, words(1)), (2, words(2)), (3, words(3)), (None, words(4)), (7, None), (8, None), (9, "")]
    assert got == sorted(want, key=str)
    assert kept(p.near_duplicates(spark, docs_of(spark, rows).limit(0), "")) == []


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, words(50, 20)), (2, None), (None, words(51, 20))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/none/benchmark.parquet")
    return folder


def test_decontaminate_judges_rows_not_ids(spark, tables):
    leak = words(60) + " " + words(50, 20) + " " + words(61)
    rows = [(1, leak), (1, words(62)), (None, leak), (None, words(63)), (4, None), (5, ""), (6, words(51, 20)), (6, words(51, 20))]
    assert kept(p.decontaminate(spark, docs_of(spark, rows), tables)) == sorted([r for r in rows if r[1] != leak], key=str)
    assert len(kept(p.decontaminate(spark, docs_of(spark, rows), f"{tables}/none"))) == len(rows)
    assert kept(p.decontaminate(spark, docs_of(spark, rows).limit(0), tables)) == []


def test_mix_takes_the_targets(spark):
    rows = [(1, words(1)), (1, words(2)), (None, words(3)), (4, None)]
    got = p.mix(spark, docs_of(spark, rows), "").collect()
    assert sum(r["taken"] for r in got) == 120 and {r["doc_id"] for r in got} <= {1, None}
    assert p.mix(spark, docs_of(spark, rows).limit(0), "").count() == 0


def test_first_stages_on_odd_rows(spark):
    rows = [(k, words(k)) for k in range(20)] + [(1, None), (None, words(30)), (3, ""), (4, "1234 5678"), (5, "x " * 100_000)]
    docs = docs_of(spark, rows)
    by_language = kept(p.language_id(spark, docs, ""))
    assert set(by_language) == {r for r in rows if re.search("[a-z]", r[1] or "")}
    assert kept(p.line_dedup(spark, docs.limit(0), "")) == [] == kept(p.language_id(spark, docs.limit(0), ""))
    lines = [(k, f"{words(k)}\nShared line") for k in range(12)] + [(0, "shared LINE"), (None, "shared line"), (20, None)]
    got = kept(p.line_dedup(spark, docs_of(spark, lines), ""))
    assert len(got) == 12 + (("shared LINE") in [t for _, t in got]) and sum("hared" in t for _, t in got) == 1


def test_run_removes_its_tables(spark, tmp_path):
    import os

    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    out = p.run(spark, "/root/testdata/sf0.001")
    left = set(os.listdir(base)) - before
    assert len(left) == 1 and len(os.listdir(f"{base}/{left.pop()}")) == 1 and out.count() > 0
