"""Queries over entities, names, articles and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspan import fixtures as fx
from reelspan.functions import images as img
from reelspan.operators import articles, images, mentions, resolve, segments, sinks
from reelspan.plans import timeline_slice as plan
from reelspan.queries import DENSITY, ENTITIES
from reelspan.registry import ORACLE_SQL, query
from reelspan.sources import annotations, transcripts
from reelspan.streaming import incremental

# ---- sources ----------------------------------------------------------------------------------------------------

LINES = """
turns AS (
  SELECT conv_id AS transcript_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS cue_idx, turn, regexp_replace(text, '\\s*\\n\\s*', ' ', 'g') AS text FROM conversations WHERE text IS NOT NULL)"""


def _srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as subtitle files, three seconds a turn."""
    talks = fx.table(spark, sf_dir, "conversations").where("text is not null")
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    cues = talks.select(F.col("conv_id").alias("transcript_id"), number.alias("cue_idx"), ((number - 1) * 3000).alias("start_ms"), (number * 3000).alias("end_ms"), "text")
    return transcripts.write_srt(cues)


CUE_SQL = f"""WITH {LINES} SELECT transcript_id, cue_idx, printf('%02d:%02d:%02d,000', (cue_idx - 1) * 3 // 3600, (cue_idx - 1) * 3 // 60 % 60, (cue_idx - 1) * 3 % 60) AS start_tc, (cue_idx - 1) * 3000 AS start_ms, cue_idx * 3000 AS end_ms, trim(text) AS text FROM turns"""


@query(CUE_SQL)
def s1_cues(spark, sf_dir):
    return transcripts.read_cues(_srt(spark, sf_dir)).select("transcript_id", "cue_idx", "start_tc", "start_ms", "end_ms", "text")


@query(CUE_SQL)
def s2_lenient_cues(spark, sf_dir):
    return transcripts.read_cues(_srt(spark, sf_dir), mode="lenient").select("transcript_id", "cue_idx", "start_tc", "start_ms", "end_ms", "text")


@query(f"WITH {LINES} SELECT transcript_id, sha256(trim(regexp_replace(string_agg(trim(text), ' ' ORDER BY cue_idx), '\\s+', ' ', 'g'))) AS digest FROM turns GROUP BY transcript_id")
def s3_full_text(spark, sf_dir):
    return transcripts.full_text(transcripts.read_cues(_srt(spark, sf_dir), mode="indexed")).select("transcript_id", F.sha2("text", 256).alias("digest"))


@query(f"WITH {LINES} SELECT transcript_id, max(cue_idx) * 3000 AS duration_ms FROM turns GROUP BY transcript_id")
def s4_durations(spark, sf_dir):
    return transcripts.durations(transcripts.read_cues(_srt(spark, sf_dir)))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's reply for every mention: its entity among its kind, as a string or an object; every 13th can't be read."""
    occ = fx.occurrences(spark, sf_dir)
    kind = F.element_at(F.array(*[F.lit(k) for k in ("people", "places", "events", "concepts")]), (F.col("event_id") % 4 + 1).cast("int"))
    item = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"name": "'), "surface", F.lit('", "canonical": "War of '), "entity", F.lit('"}'))).otherwise(F.concat(F.lit('"'), "entity", F.lit('"')))
    good = F.concat(F.lit('Sure: {"'), kind, F.lit('": ['), item, F.lit('], "primary": "'), "entity", F.lit('"} done'))
    reply = F.when(F.col("event_id") % 13 == 0, F.lit("no {json")).otherwise(good)
    return occ.select("transcript_id", "cue_idx", "ms", reply.alias("reply"))


ITEMS = (
    fx.OCC
    + """,
items AS (
  SELECT transcript_id, cue_idx, ms, (['people', 'places', 'events', 'concepts'])[event_id % 4 + 1] AS kind, 0 AS item_seq, CASE WHEN event_id % 3 = 0 THEN surface ELSE entity END AS surface,
         CASE WHEN event_id % 3 = 0 THEN 'War of ' || entity ELSE entity END AS canonical, entity AS primary_hint FROM occ WHERE event_id % 13 <> 0)"""
)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.reply_items(annotations.read_replies(_replies(spark, sf_dir)), ["transcript_id", "cue_idx", "ms"])


@query(f"WITH {ITEMS} SELECT transcript_id, cue_idx, kind, item_seq, surface, canonical FROM items")
def s6_reply_items(spark, sf_dir):
    return _items(spark, sf_dir).select("transcript_id", "cue_idx", "kind", "item_seq", "surface", "canonical")


@query(f"WITH {fx.OCC} SELECT event_id, event_id % 9 AS cue_idx, 'number' AS element_type, 0 AS item_seq, 'n' || entity AS item FROM occ WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, event_id % 9, 'quote', k, surface || k FROM occ, (VALUES (0), (1)) AS t(k) WHERE event_id % 5 <> 0")
def s8_windowed_replies(spark, sf_dir):
    occ = fx.occurrences(spark, sf_dir)
    key = F.when(F.col("event_id") % 5 == 0, F.lit("note")).otherwise((F.col("event_id") % 9).cast("string"))
    body = F.concat(F.lit('{"'), key, F.lit('": {"numbers": ["n'), "entity", F.lit('"], "quotes": ["'), "surface", F.lit('0", "'), "surface", F.lit('1"]}}'))
    return annotations.windowed_replies(occ.select("event_id", body.alias("reply"))).select("event_id", "cue_idx", "element_type", "item_seq", "item")


@query("SELECT o_orderkey AS k, 't' || o_orderkey AS search_term, o_orderstatus AS category FROM orders WHERE o_orderkey % 3 <> 0")
def s9_download_log(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    tail = F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.lit("\turl"))
    lines = orders.select(F.concat(F.lit("t"), "o_orderkey", F.lit("\tf\t"), "o_orderstatus", F.lit("\tp"), tail).alias("value"))
    return annotations.read_download_log(lines).select(F.substring("search_term", 2, 20).cast("long").alias("k"), "search_term", "category")


@query(
    r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1) AS l FROM pages), u AS (SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) AS i FROM a),
  f AS (SELECT page_id, link, min(i) AS i FROM u GROUP BY ALL) SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos FROM f"""
)
def s11_page_anchors(spark, sf_dir):
    return annotations.page_anchors(fx.table(spark, sf_dir, "pages"))


@query(
    """SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs'), '<nav>.*?</nav>', '', 'gs'), '<footer>.*?</footer>', '', 'gs')) AS chars FROM pages"""
)
def s11_page_bodies(spark, sf_dir):
    return annotations.strip_boilerplate(fx.table(spark, sf_dir, "pages")).select("page_id", F.length("html").alias("chars"))


@query(f"WITH {fx.OCC} SELECT entity, max('t' || event_id % 50) AS title FROM occ WHERE entity <> 'e0' GROUP BY entity")
def s14_overrides(spark, sf_dir):
    occ = fx.occurrences(spark, sf_dir)
    best = occ.groupBy("entity").agg(F.max(F.concat(F.lit("t"), F.col("event_id") % 50)).alias("title"))
    key = F.when(F.col("entity") == "e0", F.lit("_comment")).otherwise(F.col("entity"))
    return annotations.read_overrides(best.select(F.concat(F.lit('{"'), key, F.lit('": "'), "title", F.lit('"}')).alias("content")))


# ---- mentions ---------------------------------------------------------------------------------------------------


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = fx.occurrences(spark, sf_dir)
    hints = occ.select("transcript_id", "cue_idx", F.col("entity").alias("primary"))
    return mentions.emit_mentions(occ, _items(spark, sf_dir), hints)


ANCHORS = """nxt AS (SELECT a.transcript_id, a.cue_idx, min(b.cue_idx) AS after FROM occ a JOIN occ b ON a.transcript_id = b.transcript_id AND b.cue_idx > a.cue_idx AND b.ms - a.ms >= 5000 GROUP BY ALL),
  walk AS (SELECT transcript_id, min(cue_idx) AS cue_idx FROM occ GROUP BY transcript_id UNION ALL SELECT w.transcript_id, n.after FROM walk w JOIN nxt n ON w.transcript_id = n.transcript_id AND w.cue_idx = n.cue_idx),
  anchors AS (SELECT o.transcript_id, o.cue_idx, o.ms, max(w.cue_idx) AS anchor FROM occ o JOIN walk w ON o.transcript_id = w.transcript_id AND w.cue_idx <= o.cue_idx GROUP BY ALL)"""
EMITTED = (
    f"{ITEMS}, {ANCHORS}"
    + """,
named AS (SELECT i.*, a.anchor, canonical AS name, list_position(['people', 'places', 'events', 'concepts'], kind) AS ord FROM items i JOIN anchors a ON i.transcript_id = a.transcript_id AND i.cue_idx = a.cue_idx
  WHERE kind IN ('people', 'places') OR canonical LIKE 'War of %'),
mains AS (SELECT *, row_number() OVER (PARTITION BY transcript_id, cue_idx ORDER BY primary_hint = name DESC, ord, item_seq) = 1 AND cue_idx = min(cue_idx) OVER (PARTITION BY transcript_id, anchor) AS main FROM named),
emitted AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id, anchor, name ORDER BY cue_idx, main DESC, ord) AS k FROM mains WHERE main OR kind IN ('people', 'places')) WHERE k = 1),
merged AS (SELECT transcript_id, name, arg_min(kind, cue_idx) AS entity_type, count(*) AS mentions, min(cue_idx) AS seq, list_sort(list_distinct(list(surface))) AS aliases FROM emitted GROUP BY transcript_id, name)"""
)


@query(f"WITH RECURSIVE {EMITTED} SELECT transcript_id, cue_idx, name, surface, kind, main FROM emitted")
def w1_emitted_mentions(spark, sf_dir):
    return _gate(spark, sf_dir).select("transcript_id", "cue_idx", "name", "surface", "kind", "main")


@query(f"WITH RECURSIVE {fx.OCC}, {ANCHORS} SELECT * FROM anchors")
def w1_anchors(spark, sf_dir):
    return mentions.anchor_windows(fx.occurrences(spark, sf_dir).select("transcript_id", "cue_idx", "ms"))


@query(f"WITH RECURSIVE {EMITTED} SELECT transcript_id, name, entity_type, mentions, array_to_string(aliases, ',') AS aliases FROM merged")
def a1_merged_entities(spark, sf_dir):
    e = mentions.merge_by_canonical(_gate(spark, sf_dir))
    return e.select("transcript_id", "name", "entity_type", F.size("occurrences").alias("mentions"), F.array_join("aliases", ",").alias("aliases"))


@query(
    f"""WITH RECURSIVE {EMITTED}, counted AS (SELECT transcript_id, canonical AS name, count(*) AS n FROM items WHERE kind = 'places' GROUP BY ALL),
  subjects AS (SELECT transcript_id, name AS subject FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY n DESC, name) AS k FROM counted) WHERE k = 1),
  sites AS (SELECT transcript_id, coalesce(list(lower(name)) FILTER (entity_type = 'places'), []) AS places FROM merged GROUP BY transcript_id),
  renamed AS (SELECT m.*, CASE WHEN subject IS NOT NULL AND entity_type IN ('events', 'concepts') AND NOT contains(lower(name), lower(subject)) AND len(list_filter(places, lambda p: contains(lower(name), p))) = 0
      THEN name || ' ' || subject ELSE name END AS new_name FROM merged m JOIN sites s ON m.transcript_id = s.transcript_id LEFT JOIN subjects u ON m.transcript_id = u.transcript_id)
  SELECT transcript_id, new_name AS name, arg_min(entity_type, seq) AS entity_type, CAST(sum(mentions) AS BIGINT) AS mentions, array_to_string(list_sort(list_distinct(flatten(list(aliases)))), ',') AS aliases FROM renamed GROUP BY transcript_id, new_name"""
)
def a4_with_subjects(spark, sf_dir):
    e = mentions.add_subjects(mentions.merge_by_canonical(_gate(spark, sf_dir)), mentions.infer_subjects(_items(spark, sf_dir)))
    return e.select("transcript_id", "name", "entity_type", F.size("occurrences").alias("mentions"), F.array_join("aliases", ",").alias("aliases"))


@query(
    f"""WITH {ITEMS}, n AS (SELECT transcript_id, canonical AS name, count(*) AS n FROM items WHERE kind = 'places' GROUP BY ALL)
  SELECT transcript_id, name AS subject, n FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY n DESC, name) AS k FROM n) WHERE k = 1"""
)
def a3_subjects(spark, sf_dir):
    return mentions.infer_subjects(_items(spark, sf_dir))


GAZETTEER = [("the", "The", "concepts"), ("of the", "Of The", "events"), ("de la", "De La", "places"), ("in der", "In Der", "people")]


@query(
    f"""WITH {fx.CUES}, w AS (SELECT transcript_id, cue_idx, start_ms AS ms, list_filter(string_split(regexp_replace(lower(text), '[^\\pL\\pN\\pM_]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM cues),
  d AS (SELECT * FROM (VALUES {', '.join(str(g) for g in GAZETTEER)}) AS d(surface, canonical, kind) UNION ALL SELECT text, 'item ' || item_id, 'concepts' FROM benchmark),
  k AS (SELECT DISTINCT list_filter(string_split(regexp_replace(lower(surface), '[^\\pL\\pN\\pM_]+', ' ', 'g'), ' '), lambda x: x <> '') AS words, canonical, kind FROM d),
  g AS (SELECT transcript_id, cue_idx, ms, unnest(range(1, len(w) + 1)) AS place, unnest(w) AS word, w FROM w)
  SELECT transcript_id, cue_idx, ms, place, array_to_string(words, ' ') AS surface, canonical, kind FROM g JOIN k ON g.word = k.words[1] WHERE g.w[place:place + len(words) - 1] = k.words"""
)
def c3_gazetteer(spark, sf_dir):
    """Four short surfaces, and all benchmark items as surfaces of dozens of words."""
    known = spark.createDataFrame(GAZETTEER, "surface string, canonical string, kind string")
    items = fx.table(spark, sf_dir, "benchmark").select(F.col("text").alias("surface"), F.concat(F.lit("item "), "item_id").alias("canonical"), F.lit("concepts").alias("kind"))
    return mentions.from_gazetteer(fx.cues(spark, sf_dir), known.unionByName(items)).withColumnRenamed("at", "place")


# ---- resolution -------------------------------------------------------------------------------------------------

NAMES_SQL = """
names AS (SELECT p_size AS transcript_id, (['people', 'places'])[p_size % 2 + 1] AS entity_type, p_name AS entity, min(p_partkey) AS entity_seq FROM part GROUP BY ALL)"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fx.table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 2 == 0, "people").otherwise("places")
    return part.groupBy(F.col("p_size").alias("transcript_id"), kind.alias("entity_type"), F.col("p_name").alias("entity")).agg(F.min("p_partkey").alias("entity_seq"))


@query(f"WITH {NAMES_SQL} SELECT transcript_id, upper(entity) AS name, entity AS found FROM names")
def j4_name_lookup(spark, sf_dir):
    names = _names(spark, sf_dir)
    return resolve.lookup(names.select("transcript_id", F.upper("entity").alias("name")), names).select("transcript_id", "name", "found")


#: Matching blocks by recursion: of each two strings the longest common run, the first in a and then in b, and what is left and right of it.
SIMILAR_SQL = f"""{NAMES_SQL},
strings AS (SELECT DISTINCT lower(x.entity) AS a0, lower(y.entity) AS b0 FROM names x JOIN names y ON x.transcript_id = y.transcript_id AND x.entity_type = y.entity_type AND x.entity <> y.entity),
blocks(a0, b0, a, b, m) AS (
  SELECT a0, b0, a0, b0, 0 FROM strings
  UNION ALL
  SELECT a0, b0, unnest(['', a[:i - 1], a[i + l:]]), unnest(['', b[:j - 1], b[j + l:]]), unnest([l, 0, 0])
  FROM (SELECT *, instr(b, a[i:i + l - 1]) AS j FROM (
    SELECT a0, b0, a, b, -best.l AS l, best.i AS i FROM (
      SELECT a0, b0, a, b, list_min(list_filter(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(a) - i + 2), lambda l: {{'l': -l, 'i': i}}))), lambda x: contains(b, a[x.i:x.i - x.l - 1]))) AS best
      FROM blocks WHERE a <> '' AND b <> '') WHERE best IS NOT NULL))),
ratios AS (SELECT a0, b0, 2.0 * sum(m) / (length(a0) + length(b0)) AS ratio FROM blocks GROUP BY a0, b0),
similar_names AS (
  SELECT x.transcript_id, x.entity_type, x.entity AS a_name, x.entity_seq AS a_seq, y.entity AS b_name, y.entity_seq AS b_seq
  FROM names x JOIN names y ON x.transcript_id = y.transcript_id AND x.entity_type = y.entity_type AND x.entity <> y.entity JOIN ratios r ON r.a0 = lower(x.entity) AND r.b0 = lower(y.entity)
  WHERE contains(lower(x.entity), lower(y.entity)) OR contains(lower(y.entity), lower(x.entity)) OR ratio >= 0.7)"""

#: Leaders one after the other, each with the names that were used before it.
CLUSTERS_SQL = f"""{SIMILAR_SQL},
led AS (SELECT transcript_id, entity_type, a_name, row_number() OVER (PARTITION BY transcript_id, entity_type ORDER BY a_seq) AS k, list(b_name ORDER BY b_seq) AS partners FROM similar_names GROUP BY transcript_id, entity_type, a_name, a_seq),
taken(transcript_id, entity_type, k, used, members) AS (
  SELECT DISTINCT transcript_id, entity_type, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR[]) FROM led
  UNION ALL
  SELECT transcript_id, entity_type, k, CASE WHEN len(free) > 0 THEN list_concat(used, free, [a_name]) ELSE used END, CASE WHEN len(free) > 0 THEN list_concat([a_name], free) END
  FROM (SELECT l.transcript_id, l.entity_type, l.k, l.a_name, t.used, CASE WHEN list_contains(t.used, l.a_name) THEN [] ELSE list_filter(l.partners, lambda p: NOT list_contains(t.used, p)) END AS free
        FROM taken t JOIN led l ON l.transcript_id = t.transcript_id AND l.entity_type = t.entity_type AND l.k = t.k + 1)),
clusters AS (
  SELECT transcript_id, entity_type, row_number() OVER (PARTITION BY transcript_id, entity_type ORDER BY k) - 1 AS cluster,
         list_transform(list_sort(list_transform(members, lambda m, i: {{'l': -length(m), 'i': i, 'm': m}})), lambda x: x.m) AS members
  FROM taken WHERE members IS NOT NULL)"""


@query(f"WITH RECURSIVE {SIMILAR_SQL} SELECT transcript_id, a_name, b_name FROM similar_names")
def j6_similar_names(spark, sf_dir):
    return resolve.similar_pairs(_names(spark, sf_dir), 0.7).select("transcript_id", "a_name", "b_name")


@query(f"WITH RECURSIVE {CLUSTERS_SQL} SELECT transcript_id, entity_type, cluster, array_to_string(members, '|') AS members FROM clusters")
def d5_fuzzy_clusters(spark, sf_dir):
    return resolve.fuzzy_clusters(_names(spark, sf_dir), 0.7).withColumn("members", F.array_join("members", "|"))


@query(
    f"""WITH RECURSIVE {CLUSTERS_SQL},
  placed AS (SELECT transcript_id, entity_type, cluster, members, unnest(members) AS entity FROM clusters)
  SELECT p.transcript_id, any_value(members)[1] AS canonical, array_to_string(any_value(members)[2:], '|') AS merged_from,
    array_to_string(list_sort(list_distinct(list_concat(list(lower(p.entity)), any_value(members)[2:]))), '|') AS aliases,
    list_reduce(list_prepend('', list_transform(any_value(members), lambda m: 'context of ' || m)), lambda acc, c: CASE WHEN contains(acc, c) THEN acc WHEN acc = '' THEN c ELSE acc || ' | ' || c END) AS context,
    count(DISTINCT n.entity_seq % 7) AS total_occurrences
  FROM placed p JOIN names n ON n.transcript_id = p.transcript_id AND n.entity = p.entity GROUP BY p.transcript_id, p.entity_type, p.cluster"""
)
def a5_merged_clusters(spark, sf_dir):
    names = _names(spark, sf_dir)
    tc = F.format_string("00:00:%02d,000", F.col("entity_seq") % 7)
    full = names.select("*", F.lit(0.5).alias("priority"), F.concat(F.lit("context of "), "entity").alias("context"), F.array(F.lower("entity")).alias("aliases"), F.array(F.struct(tc.alias("timecode"), F.lit(1).alias("cue_idx"))).alias("occurrences"))
    merged = resolve.merge_clusters(full, resolve.fuzzy_clusters(names, 0.7))
    return merged.select("transcript_id", "canonical", F.array_join("merged_from", "|").alias("merged_from"), F.array_join("aliases", "|").alias("aliases"), "context", "total_occurrences")


@query(f"WITH {fx.OCC} SELECT transcript_id, entity, min(cue_idx) AS cue_idx, ms // 1000 AS second FROM occ GROUP BY transcript_id, entity, ms // 1000")
def a6_dedup_occurrences(spark, sf_dir):
    occ = fx.occurrences(spark, sf_dir).select("transcript_id", "entity", F.floor(F.col("ms") / 1000).cast("string").alias("timecode"), F.col("cue_idx").alias("seq"))
    return resolve.dedup_occurrences(occ).select("transcript_id", "entity", F.col("seq").alias("cue_idx"), F.col("timecode").cast("long").alias("second"))


@query(
    f"""WITH {fx.CUES}, w AS (SELECT *, list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^\\pL\\pN\\pM_]+', ' ', 'g'), ' '), lambda x: x <> '')) AS words FROM cues),
  l AS (SELECT transcript_id, transcript_id || '-' || cue_idx AS quote_id, substr(text, 3) AS quote FROM cues WHERE transcript_id % 20 = 0 AND length(text) > 2),
  q AS (SELECT *, trim(lower(quote), ' ' || chr(9) || chr(13)) AS low, list_distinct(list_filter(string_split(regexp_replace(lower(quote), '[^\\pL\\pN\\pM_]+', ' ', 'g'), ' '), lambda x: x <> '')) AS qw FROM l),
  s AS (SELECT quote_id, q.transcript_id, c.cue_idx, len(list_intersect(q.qw, c.words)) / CAST(greatest(len(qw), 1) AS DOUBLE) + CASE WHEN contains(lower(c.text), substr(low, 1, 30)) OR contains(low, lower(c.text)) THEN 0.5 ELSE 0.0 END AS score
    FROM q JOIN w c ON q.transcript_id = c.transcript_id WHERE len(c.words) > 0)
  SELECT quote_id, transcript_id, cue_idx, score FROM (SELECT *, row_number() OVER (PARTITION BY quote_id ORDER BY score DESC, cue_idx) AS k FROM s WHERE score >= 0.3) WHERE k = 1"""
)
def j8_quote_matches(spark, sf_dir):
    """Every line of every 20th document without its first two characters, looked for among the cues of the document."""
    cues = fx.cues(spark, sf_dir)
    quotes = cues.where("transcript_id % 20 = 0 and char_length(text) > 2").select(F.concat_ws("-", "transcript_id", "cue_idx").alias("quote_id"), "transcript_id", F.expr("substring(text, 3)").alias("quote"))
    return resolve.quote_matches(quotes, cues)


@query(
    f"""WITH {ENTITIES}, m AS (SELECT transcript_id, entity, CASE WHEN mentions >= 3 THEN mentions END AS montage_images FROM entities)
  SELECT transcript_id, entity, montage_images, montage_images IS NOT NULL AS is_montage FROM m"""
)
def j9_montage_targets(spark, sf_dir):
    e = plan.entities(fx.occurrences(spark, sf_dir))
    montages = e.where("mentions >= 3").select("transcript_id", F.array("entity").alias("entities"), F.col("mentions").alias("images"))
    return images.montage_targets(e.select("transcript_id", "entity"), montages)


# ---- articles ---------------------------------------------------------------------------------------------------


@query(
    f"""WITH {fx.ARTICLES}, q AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN title || '?' WHEN page_id % 3 = 1 THEN 'old ' || title ELSE title END AS query, title FROM articles),
  a AS (SELECT DISTINCT title FROM articles WHERE page_id % 5 <> 0 OR page_id % 10 = 0), r AS (SELECT 'old ' || title AS from_title, min(title) AS to_title FROM articles GROUP BY ALL)
  SELECT page_id, query, query IN (SELECT title FROM a) OR query IN (SELECT from_title FROM r) AS valid, coalesce((SELECT min(to_title) FROM r WHERE from_title = query), query) AS canonical FROM q"""
)
def j11_validated_titles(spark, sf_dir):
    a = fx.articles(spark, sf_dir)
    k = F.col("page_id") % 3
    queries = a.select("page_id", F.when(k == 0, F.concat("title", F.lit("?"))).when(k == 1, F.concat(F.lit("old "), "title")).otherwise(F.col("title")).alias("query"))
    known = a.where("page_id % 5 <> 0 or page_id % 10 = 0").select("title", F.when(F.col("page_id") % 10 == 0, F.lit(None).cast("boolean")).otherwise(F.lit(True)).alias("found"))
    redirects = a.select(F.concat(F.lit("old "), "title").alias("from_title"), F.col("title").alias("to_title"))
    return articles.validate_titles(queries, known, redirects).select("page_id", "query", "valid", "canonical")


HOP = """SELECT entity, page_id, is_disambiguation, hops FROM (
    SELECT t.entity, p.page_id, p.is_disambiguation, {n} AS hops, row_number() OVER (PARTITION BY t.entity ORDER BY p.is_disambiguation, CASE WHEN p.is_disambiguation THEN NULL ELSE p.title END NULLS FIRST, t.pos, p.page_id) AS k
    FROM (SELECT h.entity, unnest(a.links[1:5]) AS page_id, generate_subscripts(a.links[1:5], 1) AS pos FROM {before} h JOIN articles a ON a.page_id = h.page_id WHERE h.is_disambiguation) t JOIN articles p ON p.page_id = t.page_id) WHERE k = 1"""


@query(
    f"""WITH {fx.ARTICLES}, h0 AS (SELECT 'e' || page_id AS entity, page_id, is_disambiguation, 0 AS hops FROM articles), h1 AS ({HOP.format(n=1, before='h0')}), h2 AS ({HOP.format(n=2, before='h1')}), h3 AS ({HOP.format(n=3, before='h2')}),
  al AS (SELECT * FROM h0 WHERE NOT is_disambiguation UNION ALL SELECT * FROM h1 WHERE NOT is_disambiguation UNION ALL SELECT * FROM h2 WHERE NOT is_disambiguation UNION ALL SELECT * FROM h3)
  SELECT entity, CASE WHEN NOT is_disambiguation THEN page_id END AS page_id, hops FROM al"""
)
def j13_disambiguation(spark, sf_dir):
    a = fx.articles(spark, sf_dir)
    return articles.resolve_disambiguation(a.select(F.concat(F.lit("e"), "page_id").alias("entity"), "page_id"), a).select("entity", "page_id", "hops")


DECIDED = f"""{fx.OCC}, e AS (SELECT entity, count(*) AS n FROM occ GROUP BY entity), d AS (SELECT entity, CASE WHEN n % 3 = 0 THEN NULL ELSE 'T' || n END AS title, n % 11 AS confidence FROM e),
o AS (SELECT entity, 'M' || entity AS title FROM e WHERE n % 2 = 0)"""


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = fx.occurrences(spark, sf_dir).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    d = e.select("entity", F.when(F.col("n") % 3 != 0, F.concat(F.lit("T"), "n")).alias("title"), (F.col("n") % 11).alias("confidence"), F.lit("low").alias("match_quality"), F.lit("model").alias("source"))
    return d, e.where("n % 2 = 0").select("entity", F.concat(F.lit("M"), "entity").alias("title"))


@query(
    f"""WITH {DECIDED} SELECT d.entity, CASE WHEN d.title IS NULL THEN o.title ELSE d.title END AS title, CASE WHEN o.title IS NOT NULL AND d.title IS NULL THEN 10 ELSE confidence END AS confidence,
  CASE WHEN o.title IS NOT NULL AND d.title IS NULL THEN 'manual_override' ELSE 'model' END AS source FROM d LEFT JOIN o ON d.entity = o.entity"""
)
def j12_overrides(spark, sf_dir):
    return articles.apply_overrides(*_decided(spark, sf_dir)).select("entity", "title", "confidence", "source")


@query(f"WITH {DECIDED}, old AS (SELECT entity, title FROM d WHERE title IS NOT NULL) SELECT coalesce(o.entity, old.entity) AS entity, coalesce(o.title, old.title) AS title FROM old FULL OUTER JOIN o ON old.entity = o.entity")
def j14_merged_overrides(spark, sf_dir):
    d, o = _decided(spark, sf_dir)
    return articles.merge_overrides(d.where("title is not null").select("entity", "title"), o)


@query(
    f"""WITH {ENTITIES}, e AS (SELECT transcript_id, entity, CASE WHEN mentions % 2 = 0 THEN 'Best' ELSE '' END AS best, priority >= 0.5 AS ok, mentions FROM entities)
  SELECT transcript_id, entity, CASE WHEN best <> '' AND ok THEN 'Best,' ELSE '' END || 'q' || mentions || ',' || entity AS terms FROM e"""
)
def l6_search_terms(spark, sf_dir):
    e = plan.entities(fx.occurrences(spark, sf_dir))
    best = F.when(F.col("mentions") % 2 == 0, "Best").otherwise("")
    terms = articles.search_terms(F.col("entity"), best, F.col("priority") >= 0.5, F.array(F.concat(F.lit("q"), "mentions")))
    return e.select("transcript_id", "entity", F.array_join(terms, ",").alias("terms"))


@query(f"WITH {DECIDED} SELECT entity, CASE WHEN title IS NULL THEN 'a,T9' WHEN confidence >= 7 THEN title WHEN title = 'T9' THEN 'T9,a' ELSE title || ',a,T9' END AS terms FROM d")
def l7_terms_by_confidence(spark, sf_dir):
    d, _ = _decided(spark, sf_dir)
    terms = articles.terms_by_confidence(F.col("confidence"), F.col("title"), F.array(F.lit("a"), F.lit("T9")))
    return d.select("entity", F.array_join(terms, ",").alias("terms"))


@query(
    f"""WITH {fx.ARTICLES}, t AS (SELECT page_id, title, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\\pL\\pN\\pM_]+'), lambda w: length(w) > 2)) AS w FROM articles),
  q AS (SELECT 'e' || page_id AS entity, unnest(w) AS word FROM t WHERE page_id % 20 = 0), a AS (SELECT page_id, title, unnest(w) AS word FROM t),
  s AS (SELECT entity, page_id, title, count(*) AS score FROM q JOIN a ON q.word = a.word GROUP BY ALL)
  SELECT entity, page_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, title, page_id) AS rank FROM s) WHERE rank <= 3"""
)
def l5_top_articles(spark, sf_dir):
    a = fx.articles(spark, sf_dir)
    asked = a.where("page_id % 20 = 0").select(F.concat(F.lit("e"), "page_id").alias("entity"), F.col("title").alias("query"))
    return articles.top_articles(asked, a).select("entity", "page_id", "score", "rank")


@query(f"WITH {ENTITIES} SELECT transcript_id, batch, string_agg(entity || ' (' || entity_type || '): ' || mentions, chr(10) ORDER BY entity_seq) AS request FROM (SELECT *, (row_number() OVER (PARTITION BY transcript_id ORDER BY entity_seq) - 1) // 7 AS batch FROM entities) GROUP BY ALL")
def c4_request_batches(spark, sf_dir):
    e = plan.entities(fx.occurrences(spark, sf_dir)).withColumn("context", F.col("mentions").cast("string"))
    return articles.request_batches(e)


@query(
    f"""WITH {fx.CUES}, t AS (SELECT transcript_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN\\pM_]+'), lambda w: length(w) > 2)) AS w, cue_idx FROM cues),
  p AS (SELECT a.transcript_id, a.cue_idx, len(list_intersect(a.w, b.w)) AS n FROM t a JOIN t b ON a.transcript_id = b.transcript_id AND b.cue_idx = a.cue_idx + 1) SELECT transcript_id, cue_idx, least(n * 2, 10) AS score FROM p"""
)
def c2_context_scores(spark, sf_dir):
    cues = fx.cues(spark, sf_dir)
    after = cues.select("transcript_id", (F.col("cue_idx") - 1).alias("cue_idx"), F.col("text").alias("summary"))
    pairs = cues.join(after.hint("merge"), ["transcript_id", "cue_idx"])
    score = articles.context_score(F.col("text"), F.col("summary"), F.lit(None).cast("int"), F.expr("cast(array() as array<int>)"))
    return pairs.select("transcript_id", "cue_idx", score.alias("score"))


# ---- sinks and increments ---------------------------------------------------------------------------------------


@query(f"WITH {ENTITIES} SELECT transcript_id, count(*) AS n, sum(mentions) AS mentions FROM entities GROUP BY transcript_id")
def k1_entity_maps(spark, sf_dir):
    maps = sinks.entity_maps(plan.entities(fx.occurrences(spark, sf_dir)).select("transcript_id", "entity", "entity_type", "mentions"))
    total = F.aggregate(F.map_values("entities"), F.lit(0).cast("long"), lambda a, x: a + x["mentions"])
    return maps.select("transcript_id", F.size("entities").alias("n"), total.alias("mentions"))


@query(
    f"""WITH {fx.IMAGES}, f AS (SELECT *, replace(title, 'File:', '') AS filename FROM images WHERE license_code NOT IN ('pd', 'cc-zero'))
  SELECT filename, CASE WHEN license_code = '' THEN '' ELSE '“' || title || '” by ' || entity || ' is licensed under ' || license_code || ' via Wikimedia Commons.' END AS attribution, 'https://commons.wikimedia.org/wiki/File:' || filename AS page FROM f"""
)
def k6_attributions(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = fx.images(spark, sf_dir).withColumn("category", img.license_category(F.col("license_code"), none, none, none, none)).withColumn("filename", F.replace("title", F.lit("File:"), F.lit("")))
    placed = rows.select("filename", "category", "title", F.col("entity").alias("author"), F.col("license_code").alias("license_short"), none.alias("license_url"), F.concat(F.lit("https://upload.example/x/"), "filename").alias("source_url"), none.alias("suggested_attribution"), F.col("key").alias("clip_seq"))
    return sinks.attribution_report(placed).select("filename", "attribution", "page")


@query("SELECT page_id AS path FROM pages WHERE page_id % 4 = 0 OR page_id % 9 = 0")
def n1_changed_sources(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.sha2("html", 256).alias("sha256"))
    old = pages.where("path % 4 <> 0").withColumn("sha256", F.when(F.col("path") % 9 == 0, F.lit("old")).otherwise(F.col("sha256")))
    return incremental.changed_sources(pages, old).select("path")


STAGES = ["extract", "enrich", "merge", "markers", "timeline"]


@query(
    f"""WITH s AS (SELECT unnest({STAGES}) AS stage, unnest(range(0, 5)) AS place), t AS (SELECT c_custkey AS transcript_id FROM customer), d AS (SELECT c_custkey AS transcript_id, place FROM customer, s WHERE place < c_custkey % 6),
  f AS (SELECT t.transcript_id, min(place) AS first FROM t, s WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.transcript_id = t.transcript_id AND d.place = s.place) GROUP BY ALL)
  SELECT f.transcript_id, place, stage FROM f, s WHERE place >= first"""
)
def n2_pending_stages(spark, sf_dir):
    customers = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("transcript_id"))
    stages = F.posexplode(F.array(*[F.lit(s) for s in STAGES])).alias("place", "stage")
    done = customers.select("transcript_id", stages).where("place < transcript_id % 6")
    return incremental.pending_stages(customers, STAGES, done)


@query(
    f"""WITH RECURSIVE {DENSITY}, enums AS ({ORACLE_SQL['w4_enumerations']}),
  united AS (SELECT transcript_id, montage_id, ms, images, 'density' AS kind, 0 AS place FROM density UNION ALL SELECT transcript_id, montage_id, ms, images, 'enumeration', 2 FROM enums)
  SELECT transcript_id, montage_id, ms, images, kind, row_number() OVER (PARTITION BY transcript_id ORDER BY ms, place, montage_id) AS number FROM united"""
)
def w5_montages(spark, sf_dir):
    occ, cues = fx.occurrences(spark, sf_dir), fx.cues(spark, sf_dir)
    sweep = segments.sweep_events(plan.entities(occ).select("transcript_id", "entity", "first_ms", "entity_seq"))
    return segments.montage_union(segments.density_clusters(occ), sweep, segments.enumerations(cues, occ))
