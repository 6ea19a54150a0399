"""Queries over single functions that the other modules don't reach."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import functions as F

from reelspan import fixtures as fx
from reelspan.functions import html as markup
from reelspan.functions import images as img
from reelspan.functions import scoring
from reelspan.operators import articles, sinks
from reelspan.queries import WORDS, _categorised, _first_words
from reelspan.registry import query

REJECTED = ", ".join(f"'{w}'" for w in scoring.REJECTED_NAMES)


@query(f"WITH {WORDS} SELECT transcript_id, entity, entity IN ({REJECTED}) AS rejected FROM first_words")
def p2_rejected_names(spark, sf_dir):
    return _first_words(spark, sf_dir).select("transcript_id", "entity", scoring.rejected_name(F.col("entity")).alias("rejected"))


@query(
    r"""SELECT p_partkey AS key, array_to_string(list_filter(list_transform(list_filter(regexp_extract_all('p' || p_partkey || ' in ' || (1700 + p_size * 6) || ' or 12', '\d+'), lambda x: length(x) = 4), lambda x: x::INT), lambda y: y BETWEEN 1000 AND 2100), ',') AS years,
    list_min(list_filter(list_transform(list_filter(regexp_extract_all('p' || p_partkey || ' in ' || (1700 + p_size * 6) || ' or 12', '\d+'), lambda x: length(x) = 4), lambda x: x::INT), lambda y: y BETWEEN 1000 AND 2100)) AS first FROM part"""
)
def f14_years(spark, sf_dir):
    text = F.concat(F.lit("p"), "p_partkey", F.lit(" in "), 1700 + F.col("p_size") * 6, F.lit(" or 12"))
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.array_join(img.years(text), ",").alias("years"), img.image_year(text, F.lit("<b>none</b>")).alias("first"))


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in word)


def _plain_markup() -> str:
    """The rule of ``html.text_nodes`` for what is no text, without possessive parts and looks ahead, which the SQL's expressions lack: every part ends where the next one must begin."""
    blank = r"[\t\n\x0B\f\r ]"
    name, sep = r"[^\t\n\x0B\f\r />=]+", r"[\t\n\x0B\f\r /]"
    word = r"[^\t\n\x0B\f\r />]*"
    code, silent = "|".join(map(_any_case, ("script", "style"))), [_any_case(t) for t in ("template", "rt", "rp")]
    quoted = rf"""{name}{blank}*={blank}*(?:"[^"]*"|'[^']*')"""
    valueless = rf"{name}{blank}*={blank}*"
    bare = rf"""{name}(?:{valueless.removeprefix(name)}[^\t\n\x0B\f\r >"'{markup._CUT}][^\t\n\x0B\f\r >]*)?"""
    # After a quoted value the next attribute may follow at once, after others a blank must. The last quotes of a page,
    # which nothing closes, have a mark in front.
    attributes = rf"(?:{sep}+(?:{quoted}{sep}*|{valueless}{markup._CUT})*(?:{bare})?)*"
    tag = rf"</?[a-zA-Z]{word}(?:{attributes}{sep}*(?:{valueless})?>|[^>]*>)"
    return "|".join(
        [
            r"<!\[[cC][dD][aA][tT][aA]\[(.*?)\]\]>",
            rf"<(?:{code})(?:{sep}[^>]*)?>.*?(?:</(?:{code}){blank}*>|$)",
            *[rf"<{t}(?:{sep}[^>]*)?>.*?</{t}{blank}*>" for t in silent],
            r"<!--(?:.*?--!?>|.*$)|<[!?][^>]*>|</(?:[^a-zA-Z>][^>]*)?>",
            tag,
        ]
    )


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_NAMED = ", ".join(f"({_text(n)}, {_text(c)})" for n, c in sorted({n.rstrip(";"): c for n, c in html5.items()}.items()))
_WINDOWS = " ".join(f"WHEN {n} THEN {_text(c)}" for n, c in markup._WINDOWS.items())
_SPACE = r"[\t\n\x0B\f\r \pZ\x1c-\x1f\x{85}]+"

#: Text nodes by the rule of ``html.text_of``; references by the standard's table, with and without a semicolon, and by number.
STRIPPED = (
    rf"""WITH named(name, sign) AS (VALUES {_NAMED}),
  marked AS (SELECT row_number() OVER () AS r, page_id, regexp_replace(regexp_replace(replace(coalesce(html, ''), '{markup._CUT}', ''), '"([^"]*)$', '{markup._CUT}"\1'), '''([^'']*)$', '{markup._CUT}''\1') AS html FROM pages),
  bare AS (SELECT r, page_id, regexp_replace(html, {_text('(?s)' + _plain_markup())}, '{markup._CUT}|\1{markup._CUT}|', 'g') AS html FROM marked),
  pages_no AS (SELECT r, page_id, string_split(replace(replace(html, '{markup._CUT}"', '"'), '{markup._CUT}''', ''''), '{markup._CUT}|') AS nodes FROM bare),
  nodes AS (SELECT r, unnest(nodes) AS node, generate_subscripts(nodes, 1) AS i FROM pages_no),
  cut AS (SELECT r, i, regexp_extract_all(node, '&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z][-.a-zA-Z0-9]*);?|[^&]+|&') AS ps FROM nodes WHERE node <> ''),
  pieces AS (SELECT r, i, unnest(ps) AS p, generate_subscripts(ps, 1) AS j FROM cut),
  numbered AS (SELECT *, CASE WHEN regexp_full_match(p, '&#[xX][0-9a-fA-F]{{1,15}};?') THEN CAST('0x' || regexp_extract(p, '^&#[xX]([0-9a-fA-F]+)', 1) AS HUGEINT)
      WHEN regexp_full_match(p, '&#[0-9]{{1,30}};?') THEN CAST(regexp_extract(p, '[0-9]+') AS HUGEINT) WHEN regexp_matches(p, '^&#[xX]?[0-9a-fA-F]') THEN -1 END AS code FROM pieces),
  signs AS (SELECT n.r, n.i, n.j, CASE WHEN code IS NOT NULL THEN CASE code {_WINDOWS} ELSE CASE WHEN code BETWEEN 0 AND 55295 OR code BETWEEN 57344 AND 1114111 THEN chr(CAST(code AS INT)) ELSE '�' END END
      WHEN sign IS NOT NULL THEN sign WHEN regexp_matches(p, '^&[a-zA-Z]') THEN rtrim(p, ';') ELSE p END AS p FROM numbered n LEFT JOIN named ON starts_with(p, '&') AND name = regexp_extract(p, '^&([^;]*)', 1)),
  texts AS (SELECT r, i, regexp_replace(string_agg(p, '' ORDER BY j), '^{_SPACE}|{_SPACE}$', '', 'g') AS node FROM signs GROUP BY r, i),
  joined AS (SELECT r, string_agg(node, ' ' ORDER BY i) AS text FROM texts WHERE node <> '' GROUP BY r)
  SELECT page_id, coalesce(text, '') AS text FROM pages_no p LEFT JOIN joined j ON p.r = j.r"""
)


@query(STRIPPED)
def f16_strip_html(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", img.strip_html(F.col("html")).alias("text"))


@query(f"WITH {fx.IMAGES} SELECT key, regexp_matches(replace(regexp_replace(title, '^[^:]*:', ''), ' ', '_'), '{img.ICONS}') AS icon, contains(lower(title), 'lock-') AS listed FROM images")
def f20_icons(spark, sf_dir):
    t = F.col("title")
    return fx.images(spark, sf_dir).select("key", img.is_icon(t).alias("icon"), img.blacklisted(t).isNotNull().alias("listed"))


@query("""SELECT p_partkey AS key, regexp_replace(trim(regexp_replace(p_name || '/"x"', '[\\\\/:*?"<>|]+', '_', 'g')), '\\s+', ' ', 'g') AS folder FROM part""")
def f23_folders(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), img.safe_folder(F.concat("p_name", F.lit('/"x"'))).alias("folder"))


@query(
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 > 2 THEN 'success' WHEN o_orderkey % 4 > 0 AND o_orderkey % 3 >= o_orderkey % 4 THEN 'rate_limited' WHEN o_orderkey % 4 > 0 THEN 'no_images' ELSE 'failed' END AS status FROM orders"""
)
def p10_outcomes(spark, sf_dir):
    k = F.col("o_orderkey")
    got = F.when(k % 5 > 2, 1).otherwise(0)
    return fx.table(spark, sf_dir, "orders").select(k.alias("k"), sinks.outcome_status(got, k % 4, k % 3).alias("status"))


@query(
    """WITH x AS (SELECT CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'best' WHEN 2 THEN 'q2' WHEN 3 THEN 'name' ELSE 'else' END AS m FROM customer)
  SELECT CASE WHEN m IS NULL THEN 'failed' WHEN m = 'best' THEN 'best_title' WHEN m = 'q2' THEN 'query_2' WHEN m = 'name' THEN 'fallback' ELSE 'unknown' END AS label, count(*) AS n FROM x GROUP BY 1"""
)
def a12_strategies(spark, sf_dir):
    k = F.col("c_custkey") % 5
    matched = F.when(k == 1, "best").when(k == 2, "q2").when(k == 3, "name").when(k == 4, "else")
    label = articles.strategy_label(matched, F.lit("best"), F.array(F.lit("q1"), F.lit("q2")), F.lit("name"))
    return fx.table(spark, sf_dir, "customer").select(label.alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH e AS (SELECT s_suppkey AS entity, s_suppkey % 4 AS hits FROM supplier)
  SELECT entity, CASE WHEN hits = 0 THEN 'no_results' WHEN hits = 1 AND entity % 3 <> 0 THEN 'single_result' WHEN hits = 1 THEN 'disambiguation_page' ELSE 'model' END AS source,
    CASE WHEN hits = 1 AND entity % 3 <> 0 THEN 't0' WHEN hits > 1 AND entity % 5 <> 0 THEN 'm' || entity END AS title,
    CASE WHEN hits = 1 AND entity % 3 <> 0 THEN 7 WHEN hits > 1 AND entity % 5 <> 0 THEN entity % 11 ELSE 0 END AS confidence,
    CASE WHEN hits = 1 AND entity % 3 <> 0 THEN 'medium' WHEN hits > 1 AND entity % 5 <> 0 THEN (CASE WHEN entity % 11 >= 7 THEN 'high' WHEN entity % 11 >= 4 THEN 'medium' WHEN entity % 11 >= 1 THEN 'low' ELSE 'none' END) ELSE 'none' END AS match_quality FROM e"""
)
def c1_decisions(spark, sf_dir):
    e = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"))
    hits = F.col("entity") % 4
    found = e.where(hits > 0).select("entity", F.explode(F.sequence(F.lit(0).cast("long"), hits - 1)).alias("i")).select("entity", F.concat(F.lit("t"), "i").alias("title"), (F.col("entity") % 3 == 0).alias("is_disambiguation"))
    model = e.where("entity % 5 <> 0").select("entity", F.concat(F.lit("m"), "entity").alias("title"), (F.col("entity") % 11).cast("int").alias("confidence"))
    return articles.ingest_decisions(e, found, model).select("entity", "source", "title", "confidence", "match_quality")


@query(
    f"""WITH {fx.IMAGES}, a AS (SELECT replace(title, 'File:', '') AS filename, 'author of ' || entity AS author FROM images WHERE key % 3 = 0) SELECT key, coalesce(author, '') AS author FROM images i LEFT JOIN a ON a.filename = replace(i.title, 'File:', '')"""
)
def j10_attribution(spark, sf_dir):
    rows = _categorised(spark, sf_dir).withColumn("filename", F.replace("title", F.lit("File:"), F.lit("")))
    known = rows.where("key % 3 = 0").select("category", "filename", F.concat(F.lit("author of "), "entity").alias("author"))
    return rows.join(known.hint("merge"), ["category", "filename"], "left").select("key", F.coalesce("author", F.lit("")).alias("author"))


@query("""WITH l AS (SELECT page_id, unnest([url, 'File:' || url, 'file:x']) AS t, unnest([1, 2, 3]) AS i FROM pages), n AS (SELECT page_id, i, CASE WHEN lower(t) LIKE 'file:%' THEN t ELSE 'File:' || t END AS title FROM l)
  SELECT page_id, title, row_number() OVER (PARTITION BY page_id ORDER BY min(i)) - 1 AS pos FROM n GROUP BY page_id, title""")
def s12_page_media(spark, sf_dir):
    titles = F.transform(F.array(F.col("url"), F.concat(F.lit("File:"), "url"), F.lit("file:x")), lambda t: F.when(F.lower(t).startswith("file:"), t).otherwise(F.concat(F.lit("File:"), t)))
    return fx.table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.array_distinct(titles)).alias("pos", "title"))
