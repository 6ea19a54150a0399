"""Only what is new: changed sources, stages still to run, and transcripts as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file of a folder."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def changed_sources(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sources whose path and content the manifest doesn't have."""
    return now.join(manifest.select("path", "sha256").hint("merge"), ["path", "sha256"], "left_anti")


def pending_stages(transcripts: DataFrame, stages: list[str], done: DataFrame, start: str | None = None) -> DataFrame:
    """(transcript_id, stage, place) to run: from ``start`` on, or from each transcript's first stage that isn't done.

    The stages are a short list, so they are a literal array that every transcript explodes.
    """
    named = F.posexplode(F.array(*[F.lit(s) for s in stages])).alias("place", "stage")
    every = transcripts.select("transcript_id", named)
    if start is not None:
        return every.where(F.col("place") >= stages.index(start))
    flagged = every.join(done.select("transcript_id", "stage", F.lit(True).alias("ok")).distinct().hint("merge"), ["transcript_id", "stage"], "left")
    first = flagged.where("ok is null").groupBy("transcript_id").agg(F.min("place").alias("from"))
    return every.join(first.hint("merge"), "transcript_id").where(F.col("place") >= F.col("from")).drop("from")


def pending_entities(entities: DataFrame, *done: DataFrame) -> DataFrame:
    """Entities (transcript_id, entity, ...) that none of the ``done`` tables has: no images yet, no decision yet."""
    for d in done:
        entities = entities.join(d.select("transcript_id", "entity").distinct().hint("merge"), ["transcript_id", "entity"], "left_anti")
    return entities


def retry_failed(entities: DataFrame, statuses: tuple[str, ...] = ("failed", "no_images", "rate_limited")) -> DataFrame:
    """Entities whose download failed, without what is left of it: images and download_status become null."""
    stale = {c: F.lit(None).cast(entities.schema[c].dataType) for c in ("images", "download_status") if c in entities.columns}
    return entities.where(F.col("download_status").isin(*statuses)).withColumns(stale)


def stream_new_cues(spark: SparkSession, path: str, out: str, checkpoint: str) -> None:
    """Parse the subtitle files that have come since the last call and append their cues; each file once."""
    from reelspan.sources.transcripts import read_cues

    files = spark.readStream.schema("value string").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("transcript_id"), F.col("value").alias("content"))

    def append(batch: DataFrame, _number: int) -> None:
        read_cues(batch).write.mode("append").parquet(out)

    query = files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
