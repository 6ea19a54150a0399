"""Mixing sources to target weights with DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(per_source: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Target words of every source.

    ``per_source`` has ``source`` and ``source_size``, one row per source. Sources in code point order,
    null last, take the weights in turn; together they share ``share`` times all words. A target stops
    at ``cap`` times its source's words and the excess goes to the others by weight: the level at which
    nobody is above is found in one pass over the sources ordered by cap / weight. The window holds one
    row per source, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    ranked = (
        per_source.withColumn("weight", turn)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("ratio", F.col("most") / F.col("weight"))
    )
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return (
        ranked.withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
        .select("source", "source_size", F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most")).alias("target"))
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    share: float = 1.0,
    cap: float = 3.0,
    seed: str = "mix",
    least_ranges: int = 256,
    rows_per_range: int = 1 << 20,
) -> DataFrame:
    """Choose how many words of every document the mix takes.

    Every document gets a hash-random key (MD5 of seed and doc_id). Within a source the documents stand
    in key order; whole epochs are taken while the source's target allows, then the documents in key
    order until the target's whole words are used up, the last one in part. Prefix sums are two-level:
    word counts of key ranges per source, and a running sum inside a range. There are as many ranges as keep
    about ``rows_per_range`` rows of all sources in one, ``least_ranges`` at least, so a source with a third of all
    rows is dealt over all of them. How many there are doesn't change the result.

    Returns doc_id, source, size, source_size, target, taken and epochs (whole epochs of the source).
    Null or empty texts have size 0 and take 0. A null source is a source of its own. Rows without a
    doc_id get their key from the text. Rows repeating a doc_id are separate documents, ordered by size. An empty table
    gives no rows. Columns other than doc_id, text and source are not read, so their names don't matter.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))))
    sized = scratch.write(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("group"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            key.alias("key"),
        ),
        "sized",
    )
    ranges = max(least_ranges, -(-sized.count() // rows_per_range))
    sized = sized.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("int"))
    per_range = scratch.write(sized.groupBy("group", "source", "range").agg(F.sum("size").alias("words")), "ranges")
    targets = source_targets(per_range.groupBy("group", "source").agg(F.sum("words").alias("source_size")).drop("group"), weights, share, cap)
    targets = targets.withColumn("group", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    earlier = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    plan = scratch.write(
        per_range.select("group", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before_range")).join(targets.hint("merge"), "group"),
        "plan",
    )
    inside = Window.partitionBy("group", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    before = F.col("before_range") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return (
        sized.join(plan.hint("merge"), ["group", "range"])
        .withColumn("before", before)
        .withColumn("epochs", epochs)
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            (F.col("epochs") * F.col("size") + F.least("size", F.greatest(F.lit(0), F.col("rest") - F.col("before")))).cast("long").alias("taken"),
            "epochs",
        )
    )


#: The same in SQL, for the weights 1, 2, 3.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))) AS key
  FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM per_source),
ranked AS (
  SELECT *, source_size * CAST(3 AS DOUBLE) AS most, CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(weight) OVER () AS all_weight,
         source_size * CAST(3 AS DOUBLE) / weight AS ratio FROM weighted),
levels AS (
  SELECT *, (total - coalesce(sum(most) OVER w, 0)) / (all_weight - coalesce(sum(weight) OVER w, 0)) AS level FROM ranked
  WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         coalesce(least(most, max(CASE WHEN level <= ratio THEN level END) OVER () * weight), most) AS target FROM levels),
placed AS (
  SELECT s.*, t.source_size, t.target,
         CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
         CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
FROM placed
"""
