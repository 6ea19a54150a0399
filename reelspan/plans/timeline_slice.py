"""From mentions to selected clips: score, budget, selection, image and frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions import scoring, timecode


def entities(occ: DataFrame) -> DataFrame:
    """One row per transcript and entity: mentions, first mention, the transcript's length and the priority."""
    length = Window.partitionBy("transcript_id")
    grouped = occ.groupBy("transcript_id", "entity").agg(
        F.min_by("entity_type", "cue_idx").alias("entity_type"), F.count(F.lit(1)).alias("mentions"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.min("cue_idx").alias("entity_seq")
    )
    timed = grouped.withColumn("duration_ms", F.max("last_ms").over(length))
    return timed.withColumn("priority", scoring.priority(F.col("entity_type"), F.col("mentions"), F.col("first_ms"), F.col("duration_ms")))


def select_mentions(occ: DataFrame, budgets: DataFrame) -> DataFrame:
    """The mentions within each entity's budget: the first, the last, and some evenly between.

    ``budgets`` has transcript_id, entity, mentions and budget; both sides are hashed by transcript and
    entity once. Adds ``occ_idx``, the mention's place from 0.
    """
    inside = F.col("mentions") - 2
    rest = F.col("budget") - 2
    middle = F.expr(
        "transform(sequence(1, greatest(budget - 2, 1)), i -> 1 + least(greatest(cast(bround(cast(mentions - 2 as double) / (budget - 1) * i) as int) - 1, 0), cast(mentions as int) - 3))"
    )
    picked = (
        F.when(F.col("budget") >= F.col("mentions"), F.sequence(F.lit(0), (F.col("mentions") - 1).cast("int")))
        .when(F.col("budget") <= 0, F.expr("cast(array() as array<int>)"))
        .when(F.col("budget") == 1, F.array(F.lit(0)))
        .when((rest > 0) & (inside > 0), F.concat(F.array(F.lit(0), (F.col("mentions") - 1).cast("int")), middle))
        .otherwise(F.array(F.lit(0), (F.col("mentions") - 1).cast("int")))
    )
    wanted = budgets.select("transcript_id", "entity", F.explode(F.array_distinct(picked)).alias("occ_idx"))
    order = Window.partitionBy("transcript_id", "entity").orderBy("ms", "cue_idx")
    return occ.withColumn("occ_idx", F.row_number().over(order) - 1).join(wanted.hint("merge"), ["transcript_id", "entity", "occ_idx"])


def round_robin(chosen: DataFrame, images: DataFrame, most_bytes: int = 1 << 23) -> DataFrame:
    """Give the i-th chosen mention of an entity its image i modulo n; ``images`` has entity, image_no (from 0), image and n_images.

    The pool of images is counted: up to ``most_bytes`` it goes to every task, so mentions stay where their rank was
    computed; a larger one is joined by entity, where adaptive execution splits what many mention.
    """
    rank = F.row_number().over(Window.partitionBy("transcript_id", "entity").orderBy("occ_idx")) - 1
    size = images.agg(F.coalesce(F.sum(F.octet_length("image") + F.octet_length("entity") + 16), F.lit(0)).alias("bytes")).first()["bytes"]
    how = "broadcast" if size <= most_bytes else "merge"
    counted = images.groupBy("entity").agg(F.count(F.lit(1)).alias("n_images"))
    ranked = chosen.withColumn("rank", rank).join(counted.hint(how), "entity").withColumn("image_no", F.col("rank") % F.col("n_images"))
    return ranked.join(images.select("entity", "image_no", "image").hint(how), ["entity", "image_no"])


def clips(occ: DataFrame, images: DataFrame, fps: int = 25) -> DataFrame:
    """Which mentions get a clip, with which image, at which frame."""
    budget = scoring.placement_budget(F.col("mentions"), F.lit(False), F.col("priority"))
    budgets = entities(occ).withColumn("budget", budget).select("transcript_id", "entity", "mentions", "budget")
    placed = round_robin(select_mentions(occ, budgets), images)
    return placed.select("transcript_id", "entity", "occ_idx", "ms", "cue_idx", "image", timecode.frames_even(F.col("ms"), fps).alias("frame"))
