"""Subtitle files as cue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspan.functions import timecode
from reelspan.functions.names import strip_speakers

ARROW = r"(\d{2}:\d{2}:\d{2}[,.]\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}[,.]\d{3})"
FRAMES = r"^\[?(\d{2}:\d{2}:\d{2}:\d{2})\s*-\s*(\d{2}:\d{2}:\d{2}:\d{2})\]?$"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(transcript_id, content): every file of a folder is a transcript, named by its path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("transcript_id"), F.col("value").alias("content"))


def _blocks(files: DataFrame) -> DataFrame:
    text = F.regexp_replace(F.regexp_replace("content", "^﻿", ""), r"\r\n?", "\n")
    cut = files.select("transcript_id", F.posexplode(F.split(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")), r"\n\s*\n")).alias("pos", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return cut.select("transcript_id", "pos", lines.alias("lines")).where(F.size("lines") > 0)


def _line(k: int) -> Column:
    return F.coalesce(F.get("lines", k), F.lit(""))


def read_cues(files: DataFrame, fps: float = 25.0, mode: str = "full") -> DataFrame:
    """Cues of transcripts (transcript_id, content): transcript_id, cue_idx, start_tc, end_tc, start_ms, end_ms, text.

    ``full`` knows blocks with a number and an arrow line, with a number and a bracketed frame range, with an
    arrow line only and with a frame range only; the last two are numbered by a counter of their own. Lines
    that only name ``Speaker N`` go. Other blocks are skipped. ``indexed`` keeps the first kind only, text in
    one line; ``lenient`` takes the first arrow line of any block (commas only) and counts blocks.
    """
    blocks = _blocks(files)
    if mode == "lenient":
        comma = ARROW.replace("[,.]", ",")
        at = F.array_position(F.transform("lines", lambda x: x.rlike(comma)), True)
        found = blocks.withColumn("at", at).where("at > 0").withColumn("line", F.element_at("lines", F.col("at").cast("int")))
        rest = F.expr("slice(lines, cast(at as int) + 1, size(lines))")
        number = F.row_number().over(Window.partitionBy("transcript_id").orderBy("pos"))
        return _timed(found.select("transcript_id", number.alias("cue_idx"), F.regexp_extract("line", comma, 1).alias("start_tc"), F.regexp_extract("line", comma, 2).alias("end_tc"), F.array_join(rest, " ").alias("text")))
    numbered = _line(0).rlike(r"^\d+$")
    kind = F.when(numbered & _line(1).rlike("^" + ARROW), "number").when(numbered & _line(1).rlike(FRAMES), "number_frames").when(_line(0).rlike("^" + ARROW + "$"), "bare").when(_line(0).rlike(FRAMES), "bare_frames")
    known = blocks.withColumn("kind", kind).where("kind is not null" if mode == "full" else "kind = 'number'")
    own = F.col("kind").startswith("number")
    line, skip = F.when(own, _line(1)).otherwise(_line(0)), F.when(own, 3).otherwise(2)
    counter = F.sum((~own).cast("int")).over(Window.partitionBy("transcript_id").orderBy("pos"))
    framed = F.col("kind").endswith("frames")

    def time(k: int) -> Column:
        return F.when(framed, timecode.frame_timecode_to_text(F.regexp_extract(line, FRAMES, k), fps)).otherwise(F.translate(F.regexp_extract(line, ARROW, k), ".", ","))

    body = F.filter(F.slice("lines", skip, F.size("lines")), lambda x: ~x.rlike(r"(?i)^\s*Speaker\s+\d+\s*$"))
    text = F.trim(F.array_join(body, "\n" if mode == "full" else " "))
    return _timed(known.select("transcript_id", F.when(own, F.expr("try_cast(lines[0] as int)")).otherwise(counter).cast("int").alias("cue_idx"), time(1).alias("start_tc"), time(2).alias("end_tc"), text.alias("text")))


def _timed(cues: DataFrame) -> DataFrame:
    return cues.select("transcript_id", "cue_idx", "start_tc", "end_tc", timecode.to_ms(F.col("start_tc")).alias("start_ms"), timecode.to_ms(F.col("end_tc")).alias("end_ms"), "text")


def full_text(cues: DataFrame) -> DataFrame:
    """Whole text of each transcript, cues in order, speakers' lines out."""
    rows = F.array_sort(F.collect_list(F.struct("start_ms", "cue_idx", "text")))
    return cues.groupBy("transcript_id").agg(strip_speakers(F.array_join(F.transform(rows, lambda x: x["text"]), " ")).alias("text"))


def durations(cues: DataFrame) -> DataFrame:
    """End of the last cue of each transcript."""
    return cues.groupBy("transcript_id").agg(F.max_by("end_ms", F.struct("start_ms", "cue_idx")).alias("duration_ms"))


def write_srt(cues: DataFrame) -> DataFrame:
    """(transcript_id, content): cues as numbered subtitle blocks."""
    block = F.concat(F.col("cue_idx"), F.lit("\n"), timecode.to_text(F.col("start_ms")), F.lit(" --> "), timecode.to_text(F.col("end_ms")), F.lit("\n"), F.regexp_replace("text", r"\s*\n\s*", " "))
    return cues.select("transcript_id", "cue_idx", block.alias("b")).groupBy("transcript_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_idx", "b"))), lambda x: x["b"]), "\n\n").alias("content"))
