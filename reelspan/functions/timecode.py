"""Media time: text, milliseconds and frames as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of a timecode: the whole text with a comma; its beginning with a comma; its beginning with a comma or a stop.
STRICT = r"^(\d{2}):(\d{2}):(\d{2}),(\d{3})$"
PREFIX = r"^(\d{2}):(\d{2}):(\d{2}),(\d{3})"
EITHER = r"^(\d{2}):(\d{2}):(\d{2})[,.](\d{3})"


def to_ms(timecode: Column, form: str = STRICT) -> Column:
    """Milliseconds of ``HH:MM:SS,mmm``; 0 where the text has another form or is null."""
    part = lambda k: F.try_to_number(F.nullif(F.regexp_extract(timecode, form, k), F.lit("")), F.lit("999")).cast("bigint")
    return F.coalesce(part(1) * 3600000 + part(2) * 60000 + part(3) * 1000 + part(4), F.lit(0).cast("bigint"))


def to_text(ms: Column) -> Column:
    """``HH:MM:SS,mmm`` of milliseconds."""
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def frame_timecode_to_text(timecode: Column, fps: float = 25.0) -> Column:
    """``HH:MM:SS:FF`` at a frame rate (at least 1) as ``HH:MM:SS,mmm``; half milliseconds go to the even one."""
    parts = F.split(timecode, ":")
    ms = F.bround(parts[3].cast("double") / F.lit(max(fps, 1.0)) * 1000).cast("int")
    return F.format_string("%s:%s:%s,%03d", parts[0], parts[1], parts[2], ms)


def frames_even(ms: Column, fps: int) -> Column:
    """Frames for the timeline: half a frame goes to the even one. Whole numbers only, so no rounding of doubles."""
    twice = ms * (2 * fps)
    down = F.floor(twice / 2000)
    rest = twice - down * 2000
    return F.when(rest > 1000, down + 1).when(rest < 1000, down).otherwise(down + down % 2).cast("bigint")


def frames_down(ms: Column, fps: int) -> Column:
    """Frames for markers: cut off."""
    return F.floor(ms * fps / 1000).cast("bigint")


def frames_half_up(ms: Column, fps: int) -> Column:
    """Frames for appended clips: half a frame goes up."""
    return F.floor((ms * fps + 500) / 1000).cast("bigint")


def smpte(frames: Column, fps: int) -> Column:
    """``HH:MM:SS:FF`` of frames at a whole frame rate."""
    seconds = F.floor(frames / fps)
    return F.format_string("%02d:%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60, frames % fps)
