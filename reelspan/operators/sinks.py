"""Tables as they leave: entity maps, markers, registries, reports, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions import images, markers, timecode


def entity_maps(entities: DataFrame) -> DataFrame:
    """(transcript_id, entities): a map of each transcript's entities by name."""
    fields = [c for c in entities.columns if c not in ("transcript_id", "entity")]
    return entities.groupBy("transcript_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity", F.struct(*fields))))).alias("entities"))


def element_maps(elements: DataFrame) -> DataFrame:
    """(transcript_id, visual_elements): a map of each transcript's elements (transcript_id, element_id, ...) by id."""
    return entity_maps(elements.withColumnRenamed("element_id", "entity")).withColumnRenamed("entities", "visual_elements")


def write_bundles(documents: DataFrame, path: str) -> None:
    """Write one whole JSON document per row and line, transcript_id among its fields; as many files as tasks, however many transcripts."""
    documents.write.json(path)


def write_entity_maps(entities: DataFrame, path: str) -> None:
    """One file per transcript, for the few that leave one by one; a corpus goes into bundles."""
    entity_maps(entities).write.partitionBy("transcript_id").json(path)


def write_element_maps(elements: DataFrame, path: str) -> None:
    """One file per transcript, for the few that leave one by one; a corpus goes into bundles."""
    element_maps(elements).write.partitionBy("transcript_id").json(path)


def marker_rows(elements: DataFrame, fps: int = 25) -> DataFrame:
    """Markers in order of time: number, frame, time codes, label, colours and, where elements have one, their source text (else empty)."""
    number = F.row_number().over(Window.partitionBy("transcript_id").orderBy("ms", "element_id"))
    frame = timecode.frames_down(F.col("ms"), fps)
    return elements.select(
        "transcript_id",
        number.alias("number"),
        frame.alias("frame"),
        timecode.smpte(frame, fps).alias("tc_in"),
        timecode.smpte(frame + 1, fps).alias("tc_out"),
        markers.label(F.col("element_type"), F.col("first"), F.col("second"), F.col("element_id")).alias("label"),
        markers.color_name(F.col("element_type")).alias("color"),
        markers.color_number(F.col("element_type")).alias("color_number"),
        (F.coalesce("source_text", F.lit("")) if "source_text" in elements.columns else F.lit("")).alias("source_text"),
    )


def marker_lists(elements: DataFrame, fps: int = 25, title: str = "Markers") -> DataFrame:
    """(transcript_id, value): an event list per transcript, an event, its marker and its source text for each."""
    m = marker_rows(elements, fps)
    event = F.format_string("%03d  AX       V     C        %s %s %s %s\n* LOC: %s %s     %s", "number", "tc_in", "tc_out", "tc_in", "tc_out", "tc_in", "color", "label")
    source = F.when(F.col("source_text") != "", F.concat(F.lit("\n* SOURCE: "), F.translate("source_text", "\n\r", "  "))).otherwise("")
    rows = F.array_sort(F.collect_list(F.struct("number", F.concat(event, source).alias("e"))))
    return m.groupBy("transcript_id").agg(F.concat(F.lit(f"TITLE: {title}\nFCM: NON-DROP FRAME\n\n"), F.array_join(F.transform(rows, lambda x: x["e"]), "\n\n"), F.lit("\n")).alias("value"))


def write_marker_lists(elements: DataFrame, path: str, fps: int = 25) -> None:
    """One event list per transcript, each a file in a folder of its own."""
    marker_lists(elements, fps).write.partitionBy("transcript_id").text(path)


def excluded_report(entities: DataFrame, level: Column, least: int) -> DataFrame:
    return entities.where(level < least)


def source_page(url: Column) -> Column:
    """Page of a file from its address on the upload host."""
    name = images.url_name(url)
    return F.concat(F.lit("https://commons.wikimedia.org/wiki/File:"), F.replace(F.url_encode(F.replace(name, F.lit(" "), F.lit("_"))), F.lit("+"), F.lit("%20")))


def attribution_report(placed: DataFrame) -> DataFrame:
    """Used images that aren't in the public domain, each file name once, with its line of attribution.

    ``placed`` has clip_seq, filename, category, title, author, license_short, license_url, source_url and
    suggested_attribution.
    """
    first = F.row_number().over(Window.partitionBy("filename").orderBy("clip_seq"))
    rows = placed.where(F.col("category") != "public_domain").withColumn("k", first).where("k = 1")
    line = F.when(F.coalesce("suggested_attribution", F.lit("")) != "", F.col("suggested_attribution")).otherwise(images.attribution(F.col("title"), F.col("author"), F.col("license_short"), F.col("license_url")))
    return rows.select("filename", "category", line.alias("attribution"), source_page(F.col("source_url")).alias("page"))


def write_by_category(rows: DataFrame, path: str, sep: str = ",") -> None:
    rows.write.partitionBy("category").csv(path, header=True, sep=sep)


def append_failures(walked: DataFrame, path: str) -> None:
    """Append the rejected side of an image walk to a log."""
    walked.where("reason is not null").select("entity", "title", "reason").write.mode("append").csv(path, header=True)


def outcome_status(downloaded: Column, attempts: Column, rate_limited: Column) -> Column:
    """How the download of an entity's images ended."""
    return F.when(downloaded > 0, "success").when((attempts > 0) & (rate_limited >= attempts), "rate_limited").when(attempts > 0, "no_images").otherwise("failed")
