import importlib

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
ORACLES = importlib.import_module("reelspan.llm.queries").ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name]).fetch_df()
    got = entry.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    key = lambda df: sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()), key=str)
    assert key(got) == key(want)


def test_pipeline(spark):
    """Exact parts of the stages by brute force over what each was given."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in p.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        docs = p.Scratch(spark, "test").write(docs, name)
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept[name] <= {r["doc_id"] for r in before.select("doc_id").collect()}
        if name != "mix":
            assert docs.columns == p.COLUMNS
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(kept["language_id"]) > 0.9 * n
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert not any(b in texts[i] for i in kept["decontaminate"] for b in bench)
    assert 0 < len(kept["mix"]) <= len(kept["decontaminate"])
