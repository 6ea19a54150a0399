"""One whole document per transcript: marker lists, marker documents and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions import images
from reelspan.operators import sinks


def escaped(value: Column) -> Column:
    """Text as it stands in markup; characters that markup can't hold are left out."""
    text = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def element(tag: str, *content: Column, **attributes: Column) -> Column:
    """An element with attributes and, inside, what is given."""
    head = [F.lit(f"<{tag}")]
    for name, value in attributes.items():
        head += [F.lit(f' {name}="'), escaped(value), F.lit('"')]
    return F.concat(*head, F.lit(">"), *content, F.lit(f"</{tag}>"))


def field(tag: str, value: Column) -> Column:
    return element(tag, escaped(value))


def _in_order(order: list[str], content: Column) -> Column:
    """The contents of a group one after the other."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, content.alias("content")))), lambda x: x["content"]), "\n")


def marker_documents(elements: DataFrame, fps: int = 25, title: str = "Markers") -> DataFrame:
    """(transcript_id, value): the markers of each transcript in order of time: label, source text, frame in and out, colour."""
    rows = sinks.marker_rows(elements, fps)
    marker = element("marker", field("name", F.col("label")), field("comment", F.col("source_text")), field("in", F.col("frame")), field("out", F.col("frame") + 1), field("color", F.col("color_number")))
    body = rows.groupBy("transcript_id").agg(_in_order(["number"], marker).alias("markers"))
    head = F.concat(field("name", F.lit(title)), element("rate", field("timebase", F.lit(fps))))
    return body.select("transcript_id", element("sequence", head, F.lit("\n<markers>\n"), "markers", F.lit("\n</markers>\n")).alias("value"))


def clip_items(placements: DataFrame) -> DataFrame:
    """Clips in order of track and frame with the number of their image in the transcript's registry.

    ``placements`` has transcript_id, track, frame, duration_frames, image (a path), clip_seq and, if there is one, name (else the path's last part).
    The registry has each image once, in the order of tracks and frames, with the duration of its first clip; ``seen`` counts
    the clips of an image.
    """
    whole = Window.partitionBy("transcript_id")
    same = Window.partitionBy("transcript_id", "image").orderBy("track", "frame", "clip_seq")
    base = F.substring_index("image", "/", -1)
    name = F.coalesce(F.col("name"), base) if "name" in placements.columns else base
    # numbered by transcript first, so that all that follows stays where this exchange put it
    clips = placements.withColumn("first_place", F.row_number().over(whole.orderBy("track", "frame", "clip_seq")))
    clips = clips.withColumn("seen", F.row_number().over(same)).withColumn("media_frames", F.first("duration_frames").over(same)).withColumn("first_place", F.first("first_place").over(same))
    return clips.select(*[c for c in placements.columns if c != "name"], name.alias("name"), base.alias("base"), "media_frames", "seen", F.dense_rank().over(whole.orderBy("first_place")).alias("media_no"))


def timeline_documents(placements: DataFrame, fps: int, title: str = "Timeline") -> DataFrame:
    """(transcript_id, value): the timeline of each transcript as one document: header, registry of media, tracks with their clip items.

    The length is the last clip's end and ten seconds. Tracks run from 1 to the highest, those without clips too.
    """
    clips = clip_items(placements)
    number = lambda prefix, n: F.concat(F.lit(f"{prefix}-"), n)
    path = images.file_url(F.col("image"))
    master = element("masterclip", field("name", F.col("base")), field("duration", F.col("media_frames")), field("pathurl", path), id=number("masterclip", F.col("media_no")))
    item = element(
        "clipitem",
        field("masterclipid", number("masterclip", F.col("media_no"))),
        field("name", F.col("name")),
        field("duration", F.col("duration_frames")),
        field("start", F.col("frame")),
        field("end", F.col("frame") + F.col("duration_frames")),
        field("in", F.lit(0)),
        field("out", F.col("duration_frames")),
        field("pathurl", path),
    )
    first = F.when(F.col("seen") == 1, F.struct("media_no", master.alias("content")))
    tracks = clips.groupBy("transcript_id", "track").agg(_in_order(["frame", "clip_seq"], item).alias("items"), F.collect_list(first).alias("media"), F.max(F.col("frame") + F.col("duration_frames")).alias("end"))
    joined = tracks.groupBy("transcript_id").agg(
        F.map_from_entries(F.collect_list(F.struct("track", "items"))).alias("tracks"),
        F.max("track").alias("highest"),
        F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("media"))), lambda x: x["content"]), "\n").alias("media"),
        (F.max("end") + 10 * fps).alias("length"),
    )
    each = F.transform(F.sequence(F.lit(1), "highest"), lambda k: element("track", F.lit("\n"), F.coalesce(F.try_element_at("tracks", k), F.lit("")), F.lit("\n"), number=k))
    head = element("header", field("name", F.lit(title)), field("duration", F.col("length")), field("timebase", F.lit(fps)))
    body = element("timeline", F.lit("\n"), head, F.lit("\n<media>\n"), F.col("media"), F.lit("\n</media>\n"), F.array_join(each, "\n"), F.lit("\n"))
    return joined.select("transcript_id", body.alias("value"))


def write_documents(documents: DataFrame, path: str) -> None:
    """Write (transcript_id, value) as one file per transcript, in a folder of its name; all appear when the job is committed, or none.

    For the few that go to an editor one by one: files cost milliseconds each, so a corpus goes into bundles.
    """
    documents.write.partitionBy("transcript_id").text(path)


def read_bundles(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents written by ``sinks.write_bundles`` as transcript_id and ``document``, parsed by the schema of its content."""
    raw = spark.read.schema("transcript_id long, value string").json(path)
    return raw.select("transcript_id", F.from_xml("value", schema, {"ignoreSurroundingSpaces": "false", "mode": "FAILFAST"}).alias("document"))
