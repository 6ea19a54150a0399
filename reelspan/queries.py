"""Registered queries over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspan import fixtures as fx
from reelspan.functions import images as img
from reelspan.functions import names, scoring, timecode
from reelspan.operators import articles, enrich, segments
from reelspan.plans import timeline_slice as plan
from reelspan.registry import ORACLE_SQL, query

FPS = 24


# ---- shared SQL -------------------------------------------------------------------------------------------------

ENTITIES = (
    fx.OCC
    + """,
grouped AS (
  SELECT transcript_id, entity, arg_min(entity_type, cue_idx) AS entity_type, count(*) AS mentions, min(ms) AS first_ms, max(ms) AS last_ms, min(cue_idx) AS entity_seq
  FROM occ GROUP BY ALL),
timed AS (SELECT *, max(last_ms) OVER (PARTITION BY transcript_id) AS duration_ms FROM grouped),
entities AS (
  SELECT *, round(least(
    (CASE entity_type WHEN 'people' THEN 1.0::DOUBLE WHEN 'events' THEN 0.9::DOUBLE WHEN 'organizations' THEN 0.7::DOUBLE WHEN 'concepts' THEN 0.6::DOUBLE WHEN 'places' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END)
    * (CASE WHEN mentions <= 1 THEN 1.0::DOUBLE WHEN mentions = 2 THEN 1.3::DOUBLE WHEN mentions = 3 THEN 1.5::DOUBLE ELSE 1.6::DOUBLE END)
    * (CASE WHEN duration_ms <= 0 OR first_ms * 5 <= duration_ms THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END), 1.2::DOUBLE), 3) AS priority
  FROM timed)"""
)
BUDGETS = (
    ENTITIES
    + """,
budgets AS (
  SELECT *, CAST(CASE WHEN mentions <= 1 THEN 1 WHEN mentions >= 10 THEN least(2, mentions) WHEN priority >= 0.8 THEN least(3, mentions) WHEN priority >= 0.5 THEN least(2, mentions) ELSE 1 END AS INT) AS budget
  FROM entities)"""
)
SELECTED = (
    BUDGETS
    + """,
picks AS (
  SELECT transcript_id, entity, unnest(list_distinct(CASE
    WHEN budget >= mentions THEN range(0, mentions) WHEN budget = 1 THEN [0::BIGINT]
    WHEN budget > 2 AND mentions > 2 THEN list_concat([0::BIGINT, mentions - 1],
      list_transform(range(1, budget - 1), lambda i: (1 + least(greatest(CAST(round_even((mentions - 2)::DOUBLE / (budget - 1) * i, 0) AS BIGINT) - 1, 0), mentions - 3))::BIGINT))
    ELSE [0::BIGINT, mentions - 1] END)) AS occ_idx FROM budgets),
chosen AS (
  SELECT o.*, o.k AS occ_idx FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id, entity ORDER BY ms, cue_idx) - 1 AS k FROM occ) o
  JOIN picks p ON o.transcript_id = p.transcript_id AND o.entity = p.entity AND o.k = p.occ_idx)"""
)
POOL = (
    fx.IMAGES
    + """,
pool AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY img_pos) - 1 AS image_no, title AS image FROM images WHERE license_code IN ('pd', 'cc-zero')),
counted AS (SELECT entity, count(*) AS n_images FROM pool GROUP BY entity)"""
)
CLIPS = (
    SELECTED
    + ","
    + POOL
    + f""",
clips AS (
  SELECT c.transcript_id, c.entity, c.occ_idx, c.ms, c.cue_idx, p.image, CAST(round_even(c.ms * {FPS} / 1000.0, 0) AS BIGINT) AS frame
  FROM (SELECT c.*, n_images, row_number() OVER (PARTITION BY c.transcript_id, c.entity ORDER BY c.occ_idx) - 1 AS rank FROM chosen c JOIN counted n ON c.entity = n.entity) c
  JOIN pool p ON p.entity = c.entity AND p.image_no = c.rank % c.n_images)"""
)


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    free = fx.images(spark, sf_dir).where(F.col("license_code").isin("pd", "cc-zero"))
    return free.select("entity", (F.row_number().over(Window.partitionBy("entity").orderBy("img_pos")) - 1).alias("image_no"), F.col("title").alias("image"))


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.clips(fx.occurrences(spark, sf_dir), _pool(spark, sf_dir), FPS)


def _budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.entities(fx.occurrences(spark, sf_dir)).withColumn("budget", scoring.placement_budget(F.col("mentions"), F.lit(False), F.col("priority")))


# ---- timeline slice ---------------------------------------------------------------------------------------------


@query(f"WITH {CLIPS} SELECT * FROM clips")
def clip_plan(spark, sf_dir):
    """A2, A7, L1, L2, W15, F3: which mentions get a clip, with which image, at which frame."""
    return _clips(spark, sf_dir)


@query(f"WITH {ENTITIES} SELECT transcript_id, entity, entity_type, mentions, first_ms, duration_ms, priority FROM entities")
def a7_priority(spark, sf_dir):
    return plan.entities(fx.occurrences(spark, sf_dir)).select("transcript_id", "entity", "entity_type", "mentions", "first_ms", "duration_ms", "priority")


@query(f"WITH {BUDGETS} SELECT transcript_id, entity, mentions, budget FROM budgets")
def l1_budget(spark, sf_dir):
    return _budgets(spark, sf_dir).select("transcript_id", "entity", "mentions", "budget")


@query(f"WITH {SELECTED} SELECT transcript_id, entity, occ_idx, ms, cue_idx FROM chosen")
def l2_selection(spark, sf_dir):
    return plan.select_mentions(fx.occurrences(spark, sf_dir), _budgets(spark, sf_dir)).select("transcript_id", "entity", "occ_idx", "ms", "cue_idx")


@query(f"WITH {ENTITIES} SELECT transcript_id, entity, row_number() OVER (PARTITION BY transcript_id ORDER BY mentions DESC, entity_seq) AS place FROM entities")
def l8_by_mentions(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("transcript_id").orderBy(F.desc("mentions"), "entity_seq"))
    return plan.entities(fx.occurrences(spark, sf_dir)).select("transcript_id", "entity", place.alias("place"))


@query(f"""WITH {fx.OCC} SELECT transcript_id, count(*) AS mentions, count(DISTINCT entity) AS entities, min(ms) AS first_ms, max(ms) AS duration_ms FROM occ GROUP BY transcript_id""")
def a8_durations(spark, sf_dir):
    occ = fx.occurrences(spark, sf_dir)
    return occ.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("entity").alias("entities"), F.min("ms").alias("first_ms"), F.max("ms").alias("duration_ms"))


# ---- scalars ----------------------------------------------------------------------------------------------------


@query(
    f"""WITH {fx.OCC} SELECT event_id, tc, ms AS back, CAST(round_even(ms * 24 / 1000.0, 0) AS BIGINT) AS even, ms * 30 // 1000 AS down, (ms * 24 + 500) // 1000 AS half_up,
  printf('%02d:%02d:%02d:%02d', (ms * 25 // 1000) // 25 // 3600, (ms * 25 // 1000) // 25 // 60 % 60, (ms * 25 // 1000) // 25 % 60, (ms * 25 // 1000) % 25) AS smpte
  FROM (SELECT *, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS tc FROM occ)"""
)
def f1_timecodes(spark, sf_dir):
    occ = fx.occurrences(spark, sf_dir).withColumn("tc", timecode.to_text(F.col("ms")))
    ms = timecode.to_ms(F.col("tc"))
    return occ.select(
        "event_id",
        "tc",
        ms.alias("back"),
        timecode.frames_even(ms, 24).alias("even"),
        timecode.frames_down(ms, 30).alias("down"),
        timecode.frames_half_up(ms, 24).alias("half_up"),
        timecode.smpte(timecode.frames_down(ms, 25), 25).alias("smpte"),
    )


@query(f"""WITH {fx.CUES} SELECT transcript_id, cue_idx, trim(regexp_replace(regexp_replace(text, '(?im)^\\s*Speaker\\s+\\d+\\s*$', '', 'g'), '\\s+', ' ', 'g')) AS clean FROM cues""")
def f6_clean_text(spark, sf_dir):
    return fx.cues(spark, sf_dir).select("transcript_id", "cue_idx", names.strip_speakers(F.col("text")).alias("clean"))


NAMED = (
    fx.CUES
    + r""",
named AS (
  SELECT transcript_id, cue_idx, trim(regexp_replace(regexp_replace(text, '(?i)^\s*(\d+\s*(years?|months?|weeks?|days?)\s*(later|after|before|since)|\d{1,3}(st|nd|rd|th)\s+anniversary(?:\s+of)?\s+)', ''), '\s+', ' ', 'g'), ' ' || chr(9) || chr(13) || chr(10) || '-–—') AS name
  FROM cues)"""
)


@query(
    rf"""WITH {NAMED} SELECT transcript_id, cue_idx, name, trim(name) <> '' AND regexp_matches(name, '[A-Za-z0-9]')
  AND NOT regexp_matches(lower(name), 'years later|years earlier|years ago|decades|centuries|months later|days later')
  AND NOT regexp_matches(name, '(?i)^\s*(\d+\s*(years?|months?|weeks?|days?)\s*(later|after|before|since)|\d{{1,3}}(st|nd|rd|th)\s+anniversary(?:\s+of)?\s+)')
  AND (regexp_matches(name, '(?i)\b(war|revolution|revolt|rebellion|uprising|coup|election|elections|referendum|treaty|accord|agreement|crisis|massacre|genocide|independence|reform|protest|protests)\b') OR regexp_matches(name, '[A-Z].+')) AS plausible
  FROM named"""
)
def f7_names(spark, sf_dir):
    named = fx.cues(spark, sf_dir).select("transcript_id", "cue_idx", names.normalise(F.col("text")).alias("name"))
    return named.select("*", names.plausible(F.col("name"), F.lit("events")).alias("plausible"))


IMAGE_SQL = r"""
  SELECT key, title, lower(regexp_extract(title, '\.([^.]*)$', 1)) AS ext,
    lower(regexp_extract(title, '\.([^.]*)$', 1)) IN ('jpg','jpeg','png','gif','svg','webp','tif','tiff','bmp','ico','xcf','djvu','pdf') AS picture,
    lower(regexp_extract(title, '\.([^.]*)$', 1)) IN ('ogg','oga','ogv','ogx','opus','spx','webm','mp4','m4v','mov','avi','mpg','mpeg','mp3','wav','flac','midi','mid','aiff','aac','mka','mkv') AS sound_or_film,
    CASE WHEN license_code IN ('pd','cc-zero') THEN 'public_domain' WHEN license_code IN ('arr','unknown') THEN 'restricted_nonfree' WHEN starts_with(license_code,'cc-by-sa') THEN 'cc_by_sa'
         WHEN starts_with(license_code,'cc-by') THEN 'cc_by' WHEN starts_with(license_code,'cc-') THEN 'other_cc' ELSE 'unknown' END AS category FROM images"""


def _categorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return fx.images(spark, sf_dir).withColumn("category", img.license_category(F.col("license_code"), none, none, none, none))


@query(f"WITH {fx.IMAGES} {IMAGE_SQL}")
def f17_image_kinds(spark, sf_dir):
    t = F.col("title")
    return _categorised(spark, sf_dir).select("key", "title", img.extension(t).alias("ext"), img.is_picture(t).alias("picture"), img.is_sound_or_film(t).alias("sound_or_film"), "category")


@query(
    f"""WITH {fx.IMAGES}, c AS ({IMAGE_SQL}) SELECT i.key, CASE category WHEN 'public_domain' THEN 'Public Domain / CC0' WHEN 'restricted_nonfree' THEN 'Restricted / Non-free' WHEN 'cc_by_sa' THEN 'Creative Commons BY-SA'
    WHEN 'cc_by' THEN 'Creative Commons BY' WHEN 'other_cc' THEN 'Creative Commons (Other)' ELSE CASE WHEN license_code = '' THEN 'Unknown' ELSE 'Unknown (' || license_code || ')' END END AS label,
    CASE WHEN license_code = '' THEN '' ELSE '“' || i.title || '” by E' || i.entity || ' is licensed under ' || license_code || ' via Wikimedia Commons.' END AS line,
    'file://localhost/media/' || i.entity || '/' || replace(i.title, ':', '%3A') AS url
  FROM images i JOIN c ON i.key = c.key"""
)
def f22_attribution(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = _categorised(spark, sf_dir)
    line = img.attribution(F.col("title"), F.concat(F.lit("E"), "entity"), F.col("license_code"), none)
    return rows.select("key", img.license_label(F.col("category"), F.col("license_code"), none).alias("label"), line.alias("line"), img.file_url(F.concat_ws("/", F.lit("/media"), "entity", "title")).alias("url"))


@query("SELECT page_id, sha256(html) AS fingerprint, length(html) AS chars FROM pages")
def f27_fingerprint(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("fingerprint"), F.length("html").alias("chars"))


# ---- filters and routing ----------------------------------------------------------------------------------------


@query(
    f"""WITH {ENTITIES} SELECT transcript_id, entity, CASE WHEN entity_type IN ('people', 'events') THEN NULL
    WHEN entity_type = 'places' AND (duration_ms <= 0 OR first_ms * 10 <= duration_ms OR mentions >= 2) THEN NULL
    WHEN entity_type = 'places' AND priority < 0.8 THEN 'place with ' || mentions || ' mention(s), not in first 10%'
    WHEN entity_type = 'concepts' AND priority < 0.7 THEN 'concept priority ' || printf('%.2f', priority) || ' < 0.70'
    WHEN priority < 0.8 THEN 'priority ' || printf('%.2f', priority) || ' < 0.80' END AS skip_reason FROM entities"""
)
def p1_skip_rule(spark, sf_dir):
    e = plan.entities(fx.occurrences(spark, sf_dir))
    return e.select("transcript_id", "entity", scoring.skip_reason(F.col("entity_type"), F.col("priority"), F.col("mentions"), F.col("first_ms"), F.col("duration_ms"), 0.8).alias("skip_reason"))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.occurrences(spark, sf_dir).select("entity", "transcript_id", (F.col("event_id") % 11).cast("int").alias("confidence"), F.col("event_id").alias("seq"))


@query(
    f"""WITH {fx.OCC} SELECT event_id AS seq, CASE WHEN event_id % 11 >= 7 THEN 'high' WHEN event_id % 11 >= 4 THEN 'medium' WHEN event_id % 11 >= 1 THEN 'low' ELSE 'none' END AS quality,
  CASE WHEN event_id % 11 >= 7 THEN 'download' WHEN event_id % 11 >= 4 THEN 'flag' ELSE 'skip' END AS action, event_id % 11 >= 4 AS shown FROM occ"""
)
def p8_routing(spark, sf_dir):
    d = _decisions(spark, sf_dir).withColumn("quality", scoring.match_quality(F.col("confidence")))
    return d.select("seq", "quality", scoring.confidence_action(F.col("confidence")).alias("action"), (scoring.quality_level(F.col("quality")) >= 2).alias("shown"))


@query(
    f"""WITH {fx.OCC} SELECT entity, count(*) FILTER (WHERE event_id % 11 >= 7) AS accepted, count(*) FILTER (WHERE event_id % 11 BETWEEN 4 AND 6) AS flagged, count(*) FILTER (WHERE event_id % 11 < 4) AS skipped FROM occ GROUP BY entity"""
)
def a13_dispositions(spark, sf_dir):
    action = scoring.confidence_action(F.col("confidence"))
    return _decisions(spark, sf_dir).groupBy("entity").agg(F.count_if(action == "download").alias("accepted"), F.count_if(action == "flag").alias("flagged"), F.count_if(action == "skip").alias("skipped"))


@query(f"WITH {fx.OCC} SELECT event_id AS seq, row_number() OVER (ORDER BY event_id % 11, event_id) AS place FROM occ WHERE event_id % 11 BETWEEN 4 AND 6")
def k7_review_queue(spark, sf_dir):
    return articles.review_queue(_decisions(spark, sf_dir)).select("seq", "place")


# ---- passages ---------------------------------------------------------------------------------------------------


DENSITY = f"""{fx.OCC}, s AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY ms, cue_idx) AS seq FROM occ),
  cand AS (SELECT a.transcript_id, a.seq, a.ms, a.cue_idx, string_agg(DISTINCT b.entity, ',' ORDER BY b.entity) AS entities, count(DISTINCT b.entity) AS m, max(b.cue_idx) AS last_cue
    FROM s a JOIN s b ON a.transcript_id = b.transcript_id AND b.seq >= a.seq AND b.ms <= a.ms + 8000 GROUP BY ALL HAVING count(DISTINCT b.entity) >= 3),
  nxt AS (SELECT a.transcript_id, a.seq, min(b.seq) AS after FROM cand a JOIN cand b ON a.transcript_id = b.transcript_id AND b.cue_idx > a.last_cue AND b.seq > a.seq GROUP BY ALL),
  walk AS (SELECT transcript_id, min(seq) AS seq FROM cand GROUP BY transcript_id UNION ALL SELECT w.transcript_id, n.after FROM walk w JOIN nxt n ON w.transcript_id = n.transcript_id AND w.seq = n.seq),
  density AS (SELECT c.transcript_id, printf('density_%03d', row_number() OVER (PARTITION BY c.transcript_id ORDER BY c.seq)) AS montage_id, ms, cue_idx, entities, least(m, 5) AS images
    FROM cand c JOIN walk w ON c.transcript_id = w.transcript_id AND c.seq = w.seq)"""


@query(f"WITH RECURSIVE {DENSITY} SELECT * FROM density")
def w2_density(spark, sf_dir):
    return segments.density_clusters(fx.occurrences(spark, sf_dir)).withColumn("entities", F.array_join("entities", ","))


#: Words of three ASCII letters or more of whole cues: all of them, first places of each, and the longest of each cue.
WORDS = (
    fx.CUES
    + r""",
every_word AS (SELECT transcript_id, cue_idx, start_ms, lower(unnest(regexp_extract_all(text, '[A-Za-z]{3,}'))) AS entity FROM cues),
first_words AS (SELECT transcript_id, entity, min(start_ms) AS first_ms, min(cue_idx) AS entity_seq FROM every_word GROUP BY ALL),
named AS (SELECT transcript_id, cue_idx, start_ms, entity FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id, cue_idx ORDER BY length(entity) DESC, entity) AS k FROM every_word) WHERE k = 1)"""
)


def _cue_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues with their words of three ASCII letters or more."""
    found = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)), F.lower)
    return fx.cues(spark, sf_dir).select("transcript_id", "cue_idx", "start_ms", found.alias("words"))


def _first_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _cue_words(spark, sf_dir).select("transcript_id", "cue_idx", "start_ms", F.explode(F.array_distinct("words")).alias("entity"))
    return named.groupBy("transcript_id", "entity").agg(F.min("start_ms").alias("first_ms"), F.min("cue_idx").alias("entity_seq"))


SWEEP = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in segments.SWEEP_EVENTS) + "]"


@query(
    f"""WITH {WORDS} SELECT transcript_id, entity, printf('sweep_%03d', row_number() OVER (PARTITION BY transcript_id ORDER BY entity_seq, entity)) AS montage_id, first_ms AS ms, 4 AS images
  FROM first_words WHERE len(list_filter({SWEEP}, lambda s: contains(entity, s) OR contains(s, entity))) > 0"""
)
def w3_sweep(spark, sf_dir):
    return segments.sweep_events(_first_words(spark, sf_dir))


def _pattern(patterns) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''")


@query(
    f"""WITH {fx.CUES}, {fx.OCC}, named AS (SELECT transcript_id, cue_idx, string_agg(DISTINCT entity, ',' ORDER BY entity) AS entities, count(DISTINCT entity) AS m FROM occ GROUP BY ALL)
  SELECT c.transcript_id, printf('enum_%03d', row_number() OVER (PARTITION BY c.transcript_id ORDER BY c.cue_idx)) AS montage_id, start_ms AS ms, c.cue_idx, coalesce(entities, '') AS entities, substr(text, 1, 200) AS text, least(coalesce(m, 0) + 1, 5) AS images
  FROM cues c LEFT JOIN named n ON c.transcript_id = n.transcript_id AND c.cue_idx = n.cue_idx WHERE regexp_matches(text, '{_pattern(segments.ENUMERATION[:5])}')
  OR regexp_matches(text, '(?i)(?:^|[^\\pL\\pN_])[\\pL\\pN_]+,\\s+[\\pL\\pN_]+,\\s+and\\s+[\\pL\\pN_]')"""
)
def w4_enumerations(spark, sf_dir):
    return segments.enumerations(fx.cues(spark, sf_dir), fx.occurrences(spark, sf_dir)).withColumn("entities", F.array_join("entities", ","))


MARKED = f"""marked AS (
  SELECT *, CASE WHEN regexp_matches(text, '{_pattern(segments.PROCESS["start"])}') THEN 'start' WHEN regexp_matches(text, '{_pattern(segments.PROCESS["end"])}') THEN 'end'
    WHEN regexp_matches(text, '{_pattern(segments.PROCESS["continuation"])}') THEN 'continuation' WHEN regexp_matches(text, '{_pattern(segments.PROCESS["topic_shift"])}') THEN 'topic_shift' END AS marker FROM cues)"""


@query(f"WITH {fx.CUES}, {MARKED} SELECT transcript_id, cue_idx, marker FROM marked WHERE marker IS NOT NULL")
def w6_process_markers(spark, sf_dir):
    return segments.process_markers(fx.cues(spark, sf_dir)).select("transcript_id", "cue_idx", "marker")


@query(f"WITH {fx.CUES}, {MARKED} SELECT marker, count(*) AS n FROM marked WHERE marker IS NOT NULL GROUP BY marker")
def a10_marker_counts(spark, sf_dir):
    return segments.process_markers(fx.cues(spark, sf_dir)).groupBy("marker").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {fx.CUES} SELECT transcript_id, batch, string_agg(cue_idx, ',' ORDER BY cue_idx) AS cue_idxs
  FROM (SELECT transcript_id, cue_idx, (row_number() OVER (PARTITION BY transcript_id ORDER BY cue_idx) - 1) // 5 AS batch FROM cues) GROUP BY ALL"""
)
def w7_batches(spark, sf_dir):
    return segments.fixed_batches(fx.cues(spark, sf_dir)).withColumn("cue_idxs", F.array_join("cue_idxs", ","))


@query(
    f"""WITH {fx.CUES}, {MARKED}, r AS (SELECT transcript_id, marker, row_number() OVER (PARTITION BY transcript_id ORDER BY cue_idx) AS rn, count(*) OVER (PARTITION BY transcript_id) AS n FROM marked),
  s AS (SELECT DISTINCT transcript_id, n, unnest(range(1, n + 1, 5)) AS start FROM r),
  w AS (SELECT s.transcript_id, s.start, s.n, least(s.start + 7, s.n) AS base_end, max_by(r.marker, r.rn) FILTER (WHERE r.marker <> 'continuation') AS state FROM s JOIN r ON r.transcript_id = s.transcript_id AND r.rn BETWEEN s.start AND s.start + 7 GROUP BY ALL),
  e AS (SELECT w.*, (SELECT min(rn) FROM r WHERE r.transcript_id = w.transcript_id AND r.rn BETWEEN w.base_end + 1 AND w.base_end + 6 AND r.marker IN ('end', 'topic_shift')) AS close FROM w)
  SELECT transcript_id, start, CASE WHEN state = 'start' THEN coalesce(close, least(base_end + 6, n)) ELSE base_end END AS "end" FROM e"""
)
def w8_sliding_windows(spark, sf_dir):
    return segments.sliding_windows(fx.cues(spark, sf_dir))


@query(
    f"""WITH {fx.CUES}, r AS (SELECT transcript_id, cue_idx, row_number() OVER (PARTITION BY transcript_id ORDER BY cue_idx) - 1 AS i, count(*) OVER (PARTITION BY transcript_id) AS n FROM cues),
  m AS (SELECT *, i BETWEEN 15 AND n - 11 AND (i BETWEEN n // 4 - 1 AND n // 4 + 2 OR i BETWEEN n // 2 - 1 AND n // 2 + 2 OR i BETWEEN n * 3 // 4 - 1 AND n * 3 // 4 + 2) AS q FROM r),
  x AS (SELECT *, i BETWEEN 15 AND n - 11 AND NOT q AND abs(i - n // 2) <= 5 AS more FROM m),
  y AS (SELECT *, sum(q::INT) OVER (PARTITION BY transcript_id) AS have, sum(more::INT) OVER (PARTITION BY transcript_id ORDER BY i) AS k FROM x)
  SELECT transcript_id, cue_idx FROM y WHERE n <= 35 OR i < 15 OR i >= n - 10 OR q OR (more AND have + k <= 10)"""
)
def w11_sample(spark, sf_dir):
    return segments.sample_cues(fx.cues(spark, sf_dir)).select("transcript_id", "cue_idx")


@query(
    f"""WITH {fx.CUES}, {WORDS[len(fx.CUES) + 1:].lstrip()}, v AS (SELECT DISTINCT transcript_id, entity, cue_idx FROM named WHERE length(entity) >= 3),
  c AS (SELECT transcript_id, cue_idx AS near, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM cues),
  w AS (
  SELECT v.transcript_id, v.entity, v.cue_idx, min(near) AS first_cue, max(near) AS last_cue, trim(string_agg(c.text, ' ' ORDER BY near)) AS text
  FROM v JOIN c ON v.transcript_id = c.transcript_id AND c.near BETWEEN v.cue_idx - 3 AND v.cue_idx + 3 GROUP BY ALL) SELECT * FROM w"""
)
def j1_context_windows(spark, sf_dir):
    return enrich.single_contexts(_word_mentions(spark, sf_dir), fx.cues(spark, sf_dir))


def _word_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest word of each cue as what it mentions."""
    longest = F.array_min(F.transform("words", lambda w: F.struct((-F.length(w)).alias("size"), w.alias("word"))))["word"]
    named = _cue_words(spark, sf_dir).withColumn("entity", longest).where("entity is not null")
    return named.select("transcript_id", "entity", "cue_idx", F.col("start_ms").alias("ms"))


@query(
    ORACLE_SQL["j1_context_windows"].removesuffix(" SELECT * FROM w")
    + """,
  o AS (SELECT *, CASE WHEN first_cue > coalesce(max(last_cue) OVER (PARTITION BY transcript_id, entity ORDER BY first_cue, last_cue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -10) + 1 THEN 1 ELSE 0 END AS opens FROM w),
  i AS (SELECT *, sum(opens) OVER (PARTITION BY transcript_id, entity ORDER BY first_cue, last_cue) AS island FROM o),
  t AS (SELECT transcript_id, entity, island, string_agg(text, ' ' ORDER BY first_cue, last_cue, text) AS text FROM i GROUP BY ALL)
  SELECT transcript_id, entity, string_agg(text, ' [...] ' ORDER BY island) AS context, count(*) AS islands FROM t GROUP BY ALL"""
)
def j3_contexts(spark, sf_dir):
    return enrich.entity_contexts(_word_mentions(spark, sf_dir), fx.cues(spark, sf_dir))
