"""Context of entities: cues around their mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions.names import strip_speakers


def single_contexts(occ: DataFrame, cues: DataFrame, width: int = 3) -> DataFrame:
    """Per mention the first and last cue within ``width`` of it and their texts in order.

    Mentions and cues are dealt by transcript once: what is said about a cue meets there, and its neighbours are a frame over the
    cues' numbers, so no band is exploded and joined. Mentions of cues that don't exist drop out; gaps between cues don't matter.
    Several rows of one cue stand in order of their texts.
    """
    said = cues.select("transcript_id", F.col("cue_idx").cast("long").alias("cue_idx"), strip_speakers(F.col("text")).alias("text"), F.lit(None).cast("string").alias("entity"), F.lit(True).alias("cue"))
    named = occ.select("transcript_id", F.col("cue_idx").cast("long").alias("cue_idx"), F.lit(None).cast("string").alias("text"), "entity", F.lit(False).alias("cue"))
    texts = F.array_sort(F.collect_list("text"))
    met = said.unionByName(named).repartition("transcript_id").groupBy("transcript_id", "cue_idx").agg(F.when(F.size(texts) > 0, F.array_join(texts, " ")).alias("text"), F.collect_set("entity").alias("entities"), F.max("cue").alias("cue")).where("cue")
    near = Window.partitionBy("transcript_id").orderBy("cue_idx").rangeBetween(-width, width)
    framed = met.select("transcript_id", "cue_idx", "entities", F.min("cue_idx").over(near).alias("first_cue"), F.max("cue_idx").over(near).alias("last_cue"), F.array_join(F.collect_list("text").over(near), " ").alias("text"))
    kind = cues.schema["cue_idx"].dataType
    return framed.select("transcript_id", F.explode("entities").alias("entity"), *[F.col(c).cast(kind).alias(c) for c in ("cue_idx", "first_cue", "last_cue")], F.trim("text").alias("text"))


def merged_contexts(contexts: DataFrame, between: str = " [...] ") -> DataFrame:
    """One context per entity: windows that meet or touch are one group, groups are set apart by ``between``.

    Islands by the largest end so far, as windows of any length may come.
    """
    order = Window.partitionBy("transcript_id", "entity").orderBy("first_cue", "last_cue")
    reach = F.max("last_cue").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = contexts.withColumn("opens", F.when(F.col("first_cue") > F.coalesce(reach, F.lit(-10)) + 1, 1).otherwise(0)).withColumn("island", F.sum("opens").over(order))
    in_order = lambda value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_cue", "last_cue", value))), lambda x: x[value]), " ")
    islands = marked.groupBy("transcript_id", "entity", "island").agg(in_order("text").alias("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("island", "text"))), lambda x: x["text"]), between)
    return islands.groupBy("transcript_id", "entity").agg(whole.alias("context"), F.count(F.lit(1)).alias("islands"))


def entity_contexts(occ: DataFrame, cues: DataFrame, width: int = 3) -> DataFrame:
    return merged_contexts(single_contexts(occ, cues, width))
