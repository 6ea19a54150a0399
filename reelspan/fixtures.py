"""Transcript-shaped views of the driver's tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions: transcript_id, entity, entity_type, ms, cue_idx, surface."""
    events = table(spark, sf_dir, "events")
    user = Window.partitionBy("user_id")
    number = F.get_json_object("props", "$.k").cast("int") % 25
    kinds = F.array(*[F.lit(k) for k in ("people", "places", "events", "concepts", "organizations", "other")])
    return events.select(
        F.col("user_id").alias("transcript_id"),
        F.concat(F.lit("e"), number).alias("entity"),
        F.element_at(kinds, (number % 6 + 1).cast("int")).alias("entity_type"),
        F.expr("((unix_micros(cast(ts as timestamp)) - min(unix_micros(cast(ts as timestamp))) over (partition by user_id)) div 1000) div 7200").alias("ms"),
        F.row_number().over(user.orderBy("ts", "event_id")).alias("cue_idx"),
        F.col("event_type").alias("surface"),
        "event_id",
    )


OCC = """
occ AS (
  SELECT user_id AS transcript_id, 'e' || (CAST(json_extract_string(props, '$.k') AS INT) % 25) AS entity,
         (['people', 'places', 'events', 'concepts', 'organizations', 'other'])[CAST(json_extract_string(props, '$.k') AS INT) % 25 % 6 + 1] AS entity_type,
         ((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 1000) // 7200 AS ms,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cue_idx, event_type AS surface, event_id
  FROM events)"""


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cue of 3 s per line of a document that isn't blank; blank lines leave gaps."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").alias("transcript_id"), F.posexplode(F.split("text", "\n")).alias("i", "text")).where(F.trim("text") != "")
    return lines.select("transcript_id", (F.col("i") + 1).alias("cue_idx"), (F.col("i") * 3000).alias("start_ms"), ((F.col("i") + 1) * 3000).alias("end_ms"), "text")


CUES = """
cues AS (
  SELECT doc_id AS transcript_id, i AS cue_idx, (i - 1) * 3000 AS start_ms, i * 3000 AS end_ms, line AS text
  FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE trim(line) <> '')"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image candidates, 25 entities: entity, img_pos, key, title, year, license_code."""
    part = table(spark, sf_dir, "part")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    key = F.col("p_partkey")
    ext = pick(("jpg", "png", "svg", "ogg", "tif", "jpg", "pdf", "png", "webm"), key % 9)
    return part.select(
        F.concat(F.lit("e"), key % 25).alias("entity"),
        F.row_number().over(Window.partitionBy(key % 25).orderBy(key)).alias("img_pos"),
        key.alias("key"),
        F.concat(F.lit("File:"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), key, F.lit("."), ext).alias("title"),
        F.when(F.col("p_size") % 7 == 0, None).otherwise(1700 + F.col("p_size") * 6).cast("int").alias("year"),
        pick(("pd", "cc-by-sa-4.0", "cc-by-2.0", "cc-zero", "cc-nc", "arr", "", "x"), key % 8).alias("license_code"),
    )


IMAGES = """
images AS (
  SELECT 'e' || (p_partkey % 25) AS entity, row_number() OVER (PARTITION BY p_partkey % 25 ORDER BY p_partkey) AS img_pos, p_partkey AS key,
         'File:' || replace(p_name, ' ', '_') || '_' || p_partkey || '.' || (['jpg', 'png', 'svg', 'ogg', 'tif', 'jpg', 'pdf', 'png', 'webm'])[p_partkey % 9 + 1] AS title,
         CASE WHEN p_size % 7 = 0 THEN NULL ELSE 1700 + p_size * 6 END AS year,
         (['pd', 'cc-by-sa-4.0', 'cc-by-2.0', 'cc-zero', 'cc-nc', 'arr', '', 'x'])[p_partkey % 8 + 1] AS license_code
  FROM part)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference articles: page_id, title, is_disambiguation and six links by page id."""
    pages = table(spark, sf_dir, "pages")
    n = pages.agg(F.count(F.lit(1)).alias("n"))
    links = F.array(*[(F.col("page_id") * 7 + k) % F.col("n") for k in range(1, 7)])
    return pages.crossJoin(F.broadcast(n)).select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), (F.col("page_id") % 10 == 0).alias("is_disambiguation"), links.alias("links"))


ARTICLES = """
articles AS (
  SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, page_id % 10 = 0 AS is_disambiguation,
         [(page_id*7+1)%n, (page_id*7+2)%n, (page_id*7+3)%n, (page_id*7+4)%n, (page_id*7+5)%n, (page_id*7+6)%n] AS links
  FROM pages CROSS JOIN (SELECT count(*) AS n FROM pages))"""
