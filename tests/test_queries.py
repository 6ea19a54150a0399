from pathlib import Path

import duckdb
import pytest

from reelspan import catalog as queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df, columns):
    df = df[columns].astype(object).where(df[columns].notna(), None)
    return sorted((tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in df.values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name not in queries.ORACLE_SQL:
        assert len(got)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).fetch_df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    a, b = rows(got, columns), rows(want, columns)
    assert len(a) == len(b)
    assert [(x, y) for x, y in zip(a, b) if x != y][:3] == []


ODD_PAGES = [
    "<p>a&ampb &amp; &notit; &#65 &#x41 &#150; &#xD800; &#99999999999; &unknown; &</p>",
    "<!-- x > y --><script src=a>1<2</script><STYLE>p</STYLE ><template>no</template>one<rt>r</rt>two",
    "<![CDATA[kept]]><a b='x>y' c=\"d>e\"f=g>t</a><a =\"x>y\">u<a b=\"v>w",
    "</1>a</>b<!-- open",
    "<b c=\"</i>\"d<a b='</p></u>e<a b='",
    "\u00a0<b> \n</b>\u2003x\x0b",
    "",
    None,
]


def test_strip_html_equals_its_sql_on_odd_pages(spark, tmp_path):
    path = tmp_path / "pages.parquet"
    pages = spark.createDataFrame(list(enumerate(ODD_PAGES)), "page_id long, html string")
    pages.coalesce(1).write.parquet(str(path))
    got = {r.page_id: r.text for r in queries.QUERIES["f16_strip_html"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{path}/*.parquet'")
    want = dict(con.execute(queries.ORACLE_SQL["f16_strip_html"]).fetchall())
    assert got == want
    assert got[0] == "a&ampb & &notit A A – � � &unknown &"


@pytest.mark.parametrize(("name", "folder"), [("k4_clip_items", "timelines"), ("k4_documents", "timelines"), ("s5_entity_maps", "maps")])
def test_documents_of_many_transcripts_share_files(spark, name, folder):
    """Files follow the tasks, not the transcripts."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob(f"{folder}-*"))
    transcripts = {r.transcript_id for r in queries.QUERIES[name](spark, SF).select("transcript_id").collect()}
    (made,) = set(shared.glob(f"{folder}-*")) - before
    assert len(list(made.rglob("part-*"))) <= 4 < len(transcripts)
