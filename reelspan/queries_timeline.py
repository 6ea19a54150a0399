"""Queries over clips, tracks, gaps, markers and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspan import fixtures as fx
from reelspan.functions import images as img
from reelspan.operators import images, segments, sinks, timeline
from reelspan.plans import timeline_slice as plan
from reelspan.queries import CLIPS, ENTITIES, IMAGE_SQL, POOL, SELECTED, _budgets, _categorised, _clips, _pool
from reelspan.registry import query

TRACKS, DURATION, GAP = 4, 100, 50

NUMBERED = (
    CLIPS
    + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY frame, entity, occ_idx) AS clip_seq FROM clips)"""
)


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("transcript_id").orderBy("frame", "entity", "occ_idx")).cast("long")
    return _clips(spark, sf_dir).withColumn("clip_seq", number)


# Placements for the gap queries: clip k of a transcript on track 2 + k mod 4, which needs no search.
SPREAD = NUMBERED + f""",
placed AS (SELECT transcript_id, entity, image, clip_seq, 2 + clip_seq % {TRACKS} AS track, min(frame) AS frame, {DURATION} AS duration_frames FROM numbered GROUP BY ALL),
totals AS (SELECT transcript_id, max(ms) * 24 // 1000 + 240 AS total_frames FROM occ GROUP BY transcript_id),
ordered AS (SELECT *, lag(frame + duration_frames) OVER w AS prev_end, lag(frame) OVER w AS prev_frame, lag(duration_frames) OVER w AS prev_duration FROM placed WINDOW w AS (PARTITION BY transcript_id, track ORDER BY frame)),
lasts AS (SELECT transcript_id, track, arg_max(frame + duration_frames, frame) AS prev_end, max(frame) AS prev_frame, arg_max(duration_frames, frame) AS prev_duration FROM placed GROUP BY ALL),
every AS (SELECT transcript_id, total_frames, unnest(range(2, 2 + {TRACKS})) AS track FROM totals),
gaps AS (
  SELECT * FROM (
    SELECT transcript_id, track, coalesce(prev_end, 0) AS gap_start, frame AS gap_end, prev_frame, prev_duration FROM ordered
    UNION ALL
    SELECT e.transcript_id, e.track, coalesce(prev_end, 0), total_frames, prev_frame, prev_duration FROM every e LEFT JOIN lasts l ON e.transcript_id = l.transcript_id AND e.track = l.track)
  WHERE gap_end > gap_start)"""


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips on tracks in turn, without a search; of clips at one frame of a track only one."""
    clips = _numbered(spark, sf_dir).withColumn("track", (2 + F.col("clip_seq") % TRACKS).cast("int"))
    unique = F.row_number().over(Window.partitionBy("transcript_id", "track", "frame").orderBy("clip_seq"))
    return clips.withColumn("k", unique).where("k = 1").select("transcript_id", "entity", "image", "clip_seq", "track", "frame", F.lit(DURATION).alias("duration_frames"))


SPREAD = SPREAD.replace(
    f"placed AS (SELECT transcript_id, entity, image, clip_seq, 2 + clip_seq % {TRACKS} AS track, min(frame) AS frame, {DURATION} AS duration_frames FROM numbered GROUP BY ALL)",
    f"placed AS (SELECT transcript_id, entity, image, clip_seq, track, frame, {DURATION} AS duration_frames FROM (SELECT *, 2 + clip_seq % {TRACKS} AS track, row_number() OVER (PARTITION BY transcript_id, 2 + clip_seq % {TRACKS}, frame ORDER BY clip_seq) AS k FROM numbered) WHERE k = 1)",
)


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.occurrences(spark, sf_dir).groupBy("transcript_id").agg((F.floor(F.max("ms") * 24 / 1000) + 240).cast("long").alias("total_frames"))


@query(
    f"""WITH {SELECTED}, {POOL}, m AS (SELECT transcript_id, entity, occ_idx, CAST(round_even(ms * 24 / 1000.0, 0) AS BIGINT) AS frame FROM chosen)
  SELECT transcript_id, m.entity, occ_idx, image_no AS k, image, frame + image_no * 12 AS frame FROM m JOIN counted c ON m.entity = c.entity JOIN pool p ON p.entity = m.entity WHERE n_images >= 2 AND image_no < least(5, n_images)"""
)
def w16_montage(spark, sf_dir):
    return timeline.expand_montage(_mentions(spark, sf_dir), _arrays(spark, sf_dir), 12).select("transcript_id", "entity", "occ_idx", "k", "image", "frame")


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelspan.functions import timecode

    chosen = plan.select_mentions(fx.occurrences(spark, sf_dir), _budgets(spark, sf_dir))
    return chosen.select("transcript_id", "entity", "occ_idx", timecode.frames_even(F.col("ms"), 24).alias("frame"))


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.ranked_images(_pool(spark, sf_dir), F.col("image_no"))


STACKS = f"""{SELECTED}, {POOL}, m AS (SELECT transcript_id, entity, occ_idx, CAST(round_even(ms * 24 / 1000.0, 0) AS BIGINT) AS frame FROM chosen),
stacks AS (SELECT transcript_id, m.entity, occ_idx, frame, least(3, n_images) AS stack_size, image_no AS stack_offset, image FROM m JOIN counted c ON m.entity = c.entity JOIN pool p ON p.entity = m.entity WHERE image_no < least(3, n_images))"""


@query(f"WITH {STACKS} SELECT * FROM stacks")
def w17_stacks(spark, sf_dir):
    return timeline.expand_stacks(_mentions(spark, sf_dir), _arrays(spark, sf_dir), 3).select("transcript_id", "entity", "occ_idx", "frame", "stack_size", "stack_offset", "image")


@query(f"WITH {STACKS} SELECT transcript_id, greatest(2, max(stack_size)) AS tracks FROM stacks GROUP BY transcript_id")
def w19_grown_tracks(spark, sf_dir):
    return timeline.grown_tracks(timeline.expand_stacks(_mentions(spark, sf_dir), _arrays(spark, sf_dir), 3), 2)


PLACED_STACKS = f"""{STACKS}, pairs AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY frame, entity, occ_idx, stack_offset) AS clip_seq FROM (SELECT * REPLACE (least(2, stack_size) AS stack_size) FROM stacks WHERE stack_offset < 2)),
  together AS (SELECT transcript_id, entity, occ_idx, frame, count(*) AS size, row_number() OVER (PARTITION BY transcript_id ORDER BY min(clip_seq)) AS turn FROM pairs GROUP BY transcript_id, entity, occ_idx, frame),
  walk AS (SELECT DISTINCT transcript_id, CAST(0 AS BIGINT) AS turn, CAST([0, 0, 0, 0] AS BIGINT[]) AS free, CAST(0 AS BIGINT) AS room FROM together
    UNION ALL SELECT transcript_id, turn, list_transform(range(1, {TRACKS} + 1), lambda i: CASE WHEN i >= room AND i < room + size AND room > 0 THEN frame + {DURATION} ELSE free[i] END), room
    FROM (SELECT t.*, w.free, CAST(coalesce(
        list_min(list_filter(range(1, {TRACKS} + 2 - t.size), lambda i: len(list_filter(w.free[i:i + t.size - 1], lambda e: t.frame < e + {GAP})) = 0)),
        CASE WHEN t.size = 1 AND t.frame >= list_min(w.free) THEN list_position(w.free, list_min(w.free)) END, 0) AS BIGINT) AS room
      FROM walk w JOIN together t ON w.transcript_id = t.transcript_id AND t.turn = w.turn + 1))"""


@query(
    f"""WITH RECURSIVE {PLACED_STACKS} SELECT p.transcript_id, p.entity, p.occ_idx, p.image, p.frame, p.clip_seq, p.stack_offset, CASE WHEN room > 0 THEN room + size - stack_offset END AS track,
    CASE WHEN room = 0 THEN CASE WHEN size = 1 THEN 'tracks occupied' ELSE 'no block of tracks free' END END AS skip_reason, {DURATION} AS duration_frames
  FROM pairs p JOIN together t ON p.transcript_id = t.transcript_id AND p.entity = t.entity AND p.occ_idx = t.occ_idx AND p.frame = t.frame JOIN walk w ON w.transcript_id = t.transcript_id AND w.turn = t.turn"""
)
def w18_tracks(spark, sf_dir):
    stacks = timeline.expand_stacks(_mentions(spark, sf_dir), _arrays(spark, sf_dir), 2)
    number = F.row_number().over(Window.partitionBy("transcript_id").orderBy("frame", "entity", "occ_idx", "stack_offset")).cast("long")
    return timeline.assign_tracks(stacks.withColumn("clip_seq", number), TRACKS, DURATION, GAP)


@query(
    f"""WITH RECURSIVE {NUMBERED}, walk AS (SELECT DISTINCT transcript_id, CAST(0 AS BIGINT) AS clip_seq, CAST([0, 0, 0, 0] AS BIGINT[]) AS free, CAST(0 AS BIGINT) AS room FROM numbered
    UNION ALL SELECT transcript_id, clip_seq, list_transform(range(1, {TRACKS} + 1), lambda i: CASE WHEN i = room THEN frame + {DURATION} ELSE free[i] END), room
    FROM (SELECT n.transcript_id, n.clip_seq, n.frame, w.free, CAST(coalesce(list_min(list_filter(range(1, {TRACKS} + 1), lambda i: n.frame >= w.free[i] + {GAP})), CASE WHEN n.frame >= list_min(w.free) THEN list_position(w.free, list_min(w.free)) END, 0) AS BIGINT) AS room
      FROM walk w JOIN numbered n ON w.transcript_id = n.transcript_id AND n.clip_seq = w.clip_seq + 1))
  SELECT n.transcript_id, n.clip_seq, n.entity, n.frame, CASE WHEN room > 0 THEN room + 1 END AS track FROM numbered n JOIN walk w ON n.transcript_id = w.transcript_id AND n.clip_seq = w.clip_seq"""
)
def w18_single(spark, sf_dir):
    return timeline.assign_single(_numbered(spark, sf_dir), TRACKS, DURATION, GAP).select("transcript_id", "clip_seq", "entity", "frame", "track")


@query(f"WITH {SPREAD} SELECT * FROM gaps")
def w20_gaps(spark, sf_dir):
    return timeline.gaps(_spread(spark, sf_dir), _totals(spark, sf_dir), TRACKS)


@query(
    f"""WITH {SPREAD}, wanted AS (SELECT *, (CASE WHEN prev_frame IS NULL THEN gap_end ELSE gap_end - {GAP} END) - gap_start - {DURATION} AS room FROM gaps WHERE NOT (gap_end - gap_start < 120 AND prev_frame IS NOT NULL)),
  n AS (SELECT *, CASE WHEN room >= 0 THEN room // {DURATION + GAP} + 1 ELSE 0 END AS m FROM wanted),
  b AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY transcript_id ORDER BY track, gap_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM n WHERE m > 0)
  SELECT transcript_id, track, gap_start + k * {DURATION + GAP} AS frame, (base + k) % 7 AS pool_no, {DURATION} AS duration_frames FROM (SELECT *, unnest(range(0, m)) AS k FROM b)"""
)
def w21_fillers(spark, sf_dir):
    return timeline.fill_gaps(_spread(spark, sf_dir), _totals(spark, sf_dir), 7, TRACKS, DURATION, GAP, 120)[1]


@query(
    f"""WITH {SPREAD}, longer AS (SELECT transcript_id, track, prev_frame AS frame, gap_end - {GAP} - prev_frame AS reach FROM gaps WHERE gap_end - gap_start < 120 AND prev_frame IS NOT NULL)
  SELECT p.transcript_id, p.track, p.frame, greatest(duration_frames, coalesce(reach, 0)) AS duration_frames FROM placed p LEFT JOIN longer l ON p.transcript_id = l.transcript_id AND p.track = l.track AND p.frame = l.frame"""
)
def w21_stretched(spark, sf_dir):
    return timeline.fill_gaps(_spread(spark, sf_dir), _totals(spark, sf_dir), 7, TRACKS, DURATION, GAP, 120)[0].select("transcript_id", "track", "frame", "duration_frames")


@query(
    f"""WITH RECURSIVE {SPREAD}, n AS (SELECT p.*, coalesce(lead(frame) OVER (PARTITION BY p.transcript_id, track ORDER BY frame), total_frames) AS upto FROM placed p JOIN totals t ON p.transcript_id = t.transcript_id),
  longer AS (SELECT transcript_id, track, frame, CASE WHEN upto - frame - duration_frames > 0 AND upto - frame - duration_frames < 120 THEN greatest(duration_frames, upto - {GAP} - frame) ELSE duration_frames END AS duration_frames FROM n),
  holes AS (SELECT transcript_id, coalesce(lag(frame + duration_frames) OVER (PARTITION BY transcript_id ORDER BY frame), 0) AS a, frame AS b FROM longer WHERE track = 2
    UNION ALL SELECT t.transcript_id, coalesce((SELECT max(frame + duration_frames) FROM longer l WHERE l.transcript_id = t.transcript_id AND track = 2), 0), total_frames FROM totals t),
  slots AS (SELECT transcript_id, unnest(range(a, b - {GAP} - {DURATION} + 1, {DURATION + GAP})) AS at_frame FROM holes WHERE b > a),
  high AS (SELECT transcript_id, at_frame, (SELECT coalesce(min(track) - 2, {TRACKS}) FROM longer l WHERE l.transcript_id = s.transcript_id AND l.frame < at_frame + {DURATION + GAP} AND at_frame < l.frame + l.duration_frames + {GAP}) AS height FROM slots s),
  turns AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY at_frame) AS k FROM high),
  walk AS (SELECT DISTINCT transcript_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS entity, CAST(0 AS BIGINT) AS at_frame FROM turns
    UNION ALL SELECT transcript_id, k, coalesce((first + 1) % 25, turn), first % 25, at_frame FROM (
      SELECT w.transcript_id, t.k, t.at_frame, w.turn, list_min(list_filter(range(w.turn, w.turn + 25), lambda x: x % 5 >= 2 AND least(3, x % 5) <= t.height)) AS first
      FROM walk w JOIN turns t ON w.transcript_id = t.transcript_id AND t.k = w.k + 1)),
  stacks AS (SELECT *, least(3, entity % 5) AS size, unnest(range(0, least(3, entity % 5))) AS stack_offset FROM walk WHERE entity IS NOT NULL)
  SELECT transcript_id, track, frame, duration_frames, CAST(NULL AS VARCHAR) AS filler, CAST(NULL AS BIGINT) AS stack_offset FROM longer
  UNION ALL SELECT transcript_id, 1 + size - stack_offset, at_frame, {DURATION}, 'e' || entity, stack_offset FROM stacks"""
)
def w22_stacked_fillers(spark, sf_dir):
    pool = [(f"e{k}", k % 5) for k in range(25)]
    return timeline.fill_gaps_stacked(_spread(spark, sf_dir), _totals(spark, sf_dir), pool, TRACKS, 3, DURATION, GAP, 120)


@query(f"WITH {POOL} SELECT entity, CASE WHEN n_images < 2 THEN 0 ELSE least(3, n_images, 4) END AS three, CASE WHEN n_images < 2 THEN 0 ELSE least(n_images, 4) END AS every, 1 AS one FROM counted")
def w23_stack_height(spark, sf_dir):
    n = _pool(spark, sf_dir).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return n.select("entity", timeline.stack_height(F.col("n"), 3, 4).alias("three"), timeline.stack_height(F.col("n"), 0, 4).alias("every"), timeline.stack_height(F.col("n"), 1, 4).alias("one"))


@query(f"WITH {NUMBERED} SELECT transcript_id, clip_seq, 1000 + (clip_seq - 1) * {DURATION + GAP} AS position FROM numbered WHERE 1000 + (clip_seq - 1) * {DURATION + GAP} + {DURATION} <= 1000 + 2400")
def w24_append(spark, sf_dir):
    return timeline.append_clips(_numbered(spark, sf_dir), 1000, DURATION, GAP, 2400).select("transcript_id", "clip_seq", "position")


@query(f"WITH {SPREAD} SELECT transcript_id, clip_seq FROM placed WHERE frame >= 500 AND frame + duration_frames <= 5000")
def p9_bounds(spark, sf_dir):
    return timeline.within_bounds(_spread(spark, sf_dir), 500, 5000).select("transcript_id", "clip_seq")


@query(
    f"""WITH {SPREAD}, u AS (SELECT transcript_id, sum(duration_frames) AS used, count(*) AS clips FROM placed GROUP BY ALL)
  SELECT t.transcript_id, total_frames, coalesce(used, 0) AS used, coalesce(clips, 0) AS clips, CASE WHEN total_frames > 0 THEN coalesce(used, 0) * 1000 // (total_frames * {TRACKS}) ELSE 0 END AS coverage FROM totals t LEFT JOIN u ON t.transcript_id = u.transcript_id"""
)
def a11_coverage(spark, sf_dir):
    return timeline.coverage(_spread(spark, sf_dir), _totals(spark, sf_dir), TRACKS)


@query(f"WITH {SPREAD} SELECT transcript_id, image, duration_frames FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id, image ORDER BY track, frame, clip_seq) AS k FROM placed) WHERE k = 1")
def k4_media_registry(spark, sf_dir):
    return timeline.media_registry(_spread(spark, sf_dir))


@query(f"WITH {SPREAD} SELECT transcript_id, max(frame + duration_frames) + 240 AS length FROM placed GROUP BY transcript_id")
def k4_sequences(spark, sf_dir):
    return timeline.sequence_header(_spread(spark, sf_dir), 24)


@query(
    f"""WITH {ENTITIES}, e AS (SELECT entity, max(priority) AS priority, min(entity_seq) AS entity_seq FROM entities GROUP BY entity), p AS (SELECT * FROM (VALUES ('e7', 0), ('e3', 1), ('zz', 2)) AS t(entity, place)),
  a AS (SELECT e.entity, 0 AS part, CAST(place AS DOUBLE) AS key, entity_seq FROM p JOIN e ON p.entity = e.entity UNION ALL SELECT entity, 1, -priority, entity_seq FROM e WHERE entity NOT IN (SELECT entity FROM p))
  SELECT entity, row_number() OVER (ORDER BY part, key, entity_seq, entity) - 1 AS pool_no FROM a"""
)
def j15_filler_pool(spark, sf_dir):
    e = plan.entities(fx.occurrences(spark, sf_dir)).groupBy("entity").agg(F.max("priority").alias("priority"), F.min("entity_seq").alias("entity_seq"))
    return timeline.filler_pool(e, spark.createDataFrame([("e7", 0), ("e3", 1), ("zz", 2)], "entity string, place int"))


# ---- images -----------------------------------------------------------------------------------------------------

RANKED = f"""{fx.IMAGES}, typed AS (SELECT *, (['people', 'places', 'events'])[CAST(substr(entity, 2) AS INT) % 3 + 1] AS entity_type FROM images),
keyed AS (SELECT *, CASE WHEN entity_type = 'people' THEN (year IS NULL)::INT WHEN entity_type = 'places' THEN (CASE WHEN year IS NULL THEN 3 WHEN year BETWEEN 1800 AND 1850 THEN 0 WHEN abs(year - 1825) <= 50 THEN 1 ELSE 2 END)
    ELSE (CASE WHEN year IS NULL THEN 2 WHEN year <= 1996 THEN 0 ELSE 1 END) END AS tier,
  CASE WHEN entity_type = 'people' THEN -coalesce(year, 0) WHEN entity_type = 'places' THEN coalesce(abs(year - 1825), 999999) ELSE coalesce(year, 999999) END AS k FROM typed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY tier, k, img_pos) AS rank FROM keyed)"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("people", "places", "events")])
    number = F.substring("entity", 2, 9).cast("int")
    typed = _categorised(spark, sf_dir).withColumn("entity_type", F.element_at(kinds, number % 3 + 1))
    era = F.col("entity_type") == "places"
    return images.order_images(typed.withColumn("era_start", F.when(era, 1800)).withColumn("era_end", F.when(era, 1850)))


@query(f"WITH {RANKED} SELECT key, entity, rank FROM ranked")
def w12_image_rank(spark, sf_dir):
    return _ranked(spark, sf_dir).select("key", "entity", "rank")


CASCADE = f"""{RANKED}, kinds AS ({IMAGE_SQL}), reasons AS (
  SELECT r.*, CASE WHEN contains(lower(r.title), 'lock-') THEN 'blacklist_pattern' WHEN NOT picture THEN 'no_image_extension' WHEN r.key % 13 = 0 THEN 'no_metadata' WHEN r.key % 17 = 0 THEN 'no_url'
    WHEN r.key % 19 = 0 THEN 'non_image_mime' WHEN ext = 'svg' AND r.key % 5 = 0 THEN 'symbolic_svg' WHEN r.key % 23 = 0 THEN 'already_exists' END AS reason FROM ranked r JOIN kinds k ON r.key = k.key),
walked AS (SELECT *, reason IS NULL AS accepted FROM (SELECT *, coalesce(sum((reason IS NULL)::INT) OVER (PARTITION BY entity ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM reasons) WHERE before < 5)"""


def _walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, ext = F.col("key"), img.extension(F.col("title"))
    mime = F.when(key % 19 == 0, "audio/ogg").when(ext == "svg", "image/svg+xml").otherwise("image/jpeg")
    name = F.when(key % 5 == 0, F.lit("<b>Flag</b> of it")).otherwise("plain")
    reason = images.reject_reason(F.col("title"), key % 13 != 0, F.when(key % 17 != 0, "http://x/y"), mime, name, F.lit(""), key % 23 == 0)
    return images.walk(_ranked(spark, sf_dir).withColumn("reason", reason), F.lit(5))


@query(f"WITH {CASCADE} SELECT key, entity, rank, reason, accepted FROM walked")
def i1_image_walk(spark, sf_dir):
    return _walked(spark, sf_dir).select("key", "entity", "rank", "reason", "accepted")


@query(f"WITH {CASCADE} SELECT reason, count(*) AS n FROM walked WHERE reason IS NOT NULL GROUP BY reason")
def i5_failure_log(spark, sf_dir):
    return _walked(spark, sf_dir).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {fx.IMAGES}, k AS ({IMAGE_SQL}) SELECT category, count(*) AS n FROM k GROUP BY category")
def a14_by_category(spark, sf_dir):
    return _categorised(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {fx.IMAGES}, k AS ({IMAGE_SQL}) SELECT i.key, row_number() OVER (PARTITION BY i.entity ORDER BY CASE category WHEN 'public_domain' THEN 0 WHEN 'cc_by' THEN 1 WHEN 'cc_by_sa' THEN 2 WHEN 'other_cc' THEN 3 WHEN 'unknown' THEN 4 ELSE 5 END, img_pos) AS license_rank
  FROM images i JOIN k ON i.key = k.key"""
)
def l3_license_order(spark, sf_dir):
    return images.license_order(_categorised(spark, sf_dir)).select("key", "license_rank")


@query(f"WITH {ENTITIES} SELECT transcript_id, entity, greatest(CASE WHEN mentions >= 3 THEN 5 ELSE 3 END, CASE WHEN first_ms % 2 = 0 THEN mentions + 2 ELSE 0 END) AS images FROM entities")
def l4_image_limit(spark, sf_dir):
    e = plan.entities(fx.occurrences(spark, sf_dir))
    return e.select("transcript_id", "entity", images.image_limit(F.col("mentions"), F.when(F.col("first_ms") % 2 == 0, F.col("mentions") + 2)).alias("images"))


TWINS = f"""{fx.IMAGES}, t AS (SELECT entity, key, regexp_replace(title, '_[0-9]+\\.', '.') AS title, lower(regexp_extract(title, '\\.([^.]*)$', 1)) AS ext, lower(regexp_replace(regexp_replace(title, '_[0-9]+\\.', '.'), '\\.[^.]*$', '')) AS base FROM images)"""


@query(f"WITH {TWINS} SELECT key, title FROM t WHERE ext <> 'svg' OR NOT EXISTS (SELECT 1 FROM t p WHERE p.ext = 'png' AND p.entity = t.entity AND p.base = t.base)")
def d1_svg_twins(spark, sf_dir):
    same = fx.images(spark, sf_dir).withColumn("title", F.regexp_replace("title", r"_[0-9]+\.", "."))
    return images.drop_svg_twins(same).select("key", "title")


@query(f"WITH {TWINS} SELECT entity, title, min(key) AS key FROM t GROUP BY entity, title")
def d2_first_path(spark, sf_dir):
    same = fx.images(spark, sf_dir).withColumn("path", F.regexp_replace("title", r"_[0-9]+\.", ".")).withColumn("transcript_id", F.lit(0))
    return images.dedup_paths(same).select("entity", F.col("path").alias("title"), "key")


@query(f"WITH {fx.IMAGES} SELECT key, title, license_code FROM images i WHERE key % 4 = (SELECT min(key % 4) FROM images j WHERE j.entity = i.entity)")
def i3_first_source(spark, sf_dir):
    return images.first_source(fx.images(spark, sf_dir).withColumn("source_order", F.col("key") % 4)).select("key", "title", "license_code")


# ---- visual elements and markers --------------------------------------------------------------------------------

ELEMENTS = """
elements AS (
  SELECT l_suppkey % 50 AS transcript_id, (['date', 'quote', 'number', 'process', 'comparison', 'other'])[l_linenumber % 6 + 1] AS element_type, l_partkey % 50 AS cue_idx, CAST(l_quantity AS BIGINT) AS q,
         'v' || CAST(l_quantity AS BIGINT) AS first, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_returnflag END AS second, (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 60 + CAST(l_quantity AS BIGINT) AS seq, (l_partkey % 50) * 3000 + l_linenumber * 40 AS ms
  FROM lineitem)"""
DEDUPED = (
    ELEMENTS
    + """,
ided AS (SELECT *, printf('%s_%03d', element_type, row_number() OVER (PARTITION BY transcript_id, element_type ORDER BY seq)) AS element_id FROM elements),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id, element_type, cue_idx, CASE WHEN element_type = 'quote' THEN substr(first, 1, 50) ELSE first || chr(31) || second END ORDER BY seq) AS k FROM ided) WHERE k = 1)"""
)


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("date", "quote", "number", "process", "comparison", "other")])
    line = fx.table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("bigint")
    rows = line.select(
        (F.col("l_suppkey") % 50).alias("transcript_id"),
        F.element_at(kinds, (F.col("l_linenumber") % 6 + 1).cast("int")).alias("element_type"),
        (F.col("l_partkey") % 50).alias("cue_idx"),
        F.concat(F.lit("v"), q).alias("first"),
        F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.col("l_returnflag")).alias("second"),
        ((((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")) * 60 + q).alias("seq"),
        ((F.col("l_partkey") % 50) * 3000 + F.col("l_linenumber") * 40).alias("ms"),
    )
    return segments.numbered_elements(rows)


@query(f"WITH {DEDUPED} SELECT transcript_id, element_type, cue_idx, seq, element_id FROM once")
def w9_elements(spark, sf_dir):
    return _elements(spark, sf_dir).select("transcript_id", "element_type", "cue_idx", "seq", "element_id")


@query(f"WITH {DEDUPED} SELECT element_type, count(*) AS n, count(DISTINCT transcript_id) AS transcripts FROM once GROUP BY element_type")
def a10_element_counts(spark, sf_dir):
    return _elements(spark, sf_dir).groupBy("element_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("transcript_id").alias("transcripts"))


MARKER_SQL = f"""WITH {DEDUPED}, m AS (
  SELECT transcript_id, row_number() OVER (PARTITION BY transcript_id ORDER BY ms, element_id) AS number, ms * 25 // 1000 AS frame,
    CASE element_type WHEN 'date' THEN 'DATE: ' || first || CASE WHEN second <> '' THEN ' - ' || second ELSE '' END WHEN 'quote' THEN 'QUOTE: "' || first || '"' WHEN 'number' THEN 'NUMBER: ' || first || CASE WHEN second <> '' THEN ' ' || second ELSE '' END
      WHEN 'process' THEN 'PROCESS: ' || first || ' (' || second || ' steps)' WHEN 'comparison' THEN 'COMPARISON: ' || first || ' vs ' || second ELSE upper(element_type) || ': ' || element_id END AS label,
    CASE element_type WHEN 'date' THEN 'BLUE' WHEN 'quote' THEN 'GREEN' WHEN 'number' THEN 'YELLOW' WHEN 'process' THEN 'RED' WHEN 'comparison' THEN 'PURPLE' ELSE 'WHITE' END AS color,
    CASE element_type WHEN 'date' THEN 9 WHEN 'quote' THEN 12 WHEN 'number' THEN 6 WHEN 'process' THEN 2 WHEN 'comparison' THEN 3 ELSE 0 END AS color_number FROM once)
  SELECT *, printf('%02d:%02d:%02d:%02d', frame // 90000, frame // 1500 % 60, frame // 25 % 60, frame % 25) AS tc_in, printf('%02d:%02d:%02d:%02d', (frame + 1) // 90000, (frame + 1) // 1500 % 60, (frame + 1) // 25 % 60, (frame + 1) % 25) AS tc_out FROM m"""


@query(MARKER_SQL)
def k2_markers(spark, sf_dir):
    return sinks.marker_rows(_elements(spark, sf_dir)).drop("source_text")


SOURCED = f"""{MARKER_SQL.replace("AS label,", "AS label, 'says ' || first || chr(10) || '& more' AS source_text,")}"""


def _sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir).withColumn("source_text", F.concat(F.lit("says "), "first", F.lit("\n& more")))


@query(
    f"""SELECT transcript_id, sha256('TITLE: Markers' || chr(10) || 'FCM: NON-DROP FRAME' || chr(10) || string_agg(chr(10) || printf('%03d', number) || '  AX       V     C        ' || tc_in || ' ' || tc_out || ' ' || tc_in || ' ' || tc_out || chr(10)
      || '* LOC: ' || tc_in || ' ' || color || '     ' || label || chr(10) || '* SOURCE: ' || replace(source_text, chr(10), ' ') || chr(10), '' ORDER BY number)) AS digest FROM ({SOURCED}) GROUP BY transcript_id"""
)
def k2_marker_lists(spark, sf_dir):
    """Event lists of all transcripts, one document each."""
    return sinks.marker_lists(_sourced(spark, sf_dir)).select("transcript_id", F.sha2("value", 256).alias("digest"))


@query(f"SELECT transcript_id, sha256(string_agg(number || tc_in || label, chr(10) ORDER BY number)) AS digest FROM ({MARKER_SQL}) GROUP BY transcript_id")
def k2_marker_digest(spark, sf_dir):
    rows = sinks.marker_rows(_elements(spark, sf_dir)).select("transcript_id", "number", F.concat("number", "tc_in", "label").alias("v"))
    return rows.groupBy("transcript_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "v"))), lambda x: x["v"]), "\n"), 256).alias("digest"))
