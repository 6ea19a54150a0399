"""Entity names and cue texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of relative time at the start of a name, and what makes a name an event.
RELATIVE_TIME = r"(?i)^\s*(\d+\s*(years?|months?|weeks?|days?)\s*(later|after|before|since)|\d{1,3}(st|nd|rd|th)\s+anniversary(?:\s+of)?\s+)"
EVENT_WORDS = r"(?i)\b(war|revolution|revolt|rebellion|uprising|coup|election|elections|referendum|treaty|accord|agreement|crisis|massacre|genocide|independence|reform|protest|protests)\b"
NOT_NAMES = ("years later", "years earlier", "years ago", "decades", "centuries", "months later", "days later")
VAGUE_AFTER_YEAR = r"\b(election|elections|war|revolution|coup|crisis|protest|uprising|referendum)\b"
VAGUE_WORDS = r"\b(election|elections|war|revolution|movement|uprising|coup|crisis|protest|referendum)\b"


def strip_speakers(text: Column) -> Column:
    """Drop lines that only name ``Speaker N``, make white space single spaces, trim."""
    bare = F.regexp_replace(text, r"(?im)^\s*Speaker\s+\d+\s*$", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def normalise(name: Column) -> Column:
    """Drop a leading phrase of relative time, make white space single spaces, trim spaces and dashes."""
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), RELATIVE_TIME, "")
    return F.btrim(F.regexp_replace(bare, r"\s+", " "), F.lit(" \t\r\n-–—"))


def plausible(name: Column, kind: Column) -> Column:
    """Whether a name may stand for an entity; events and concepts need an event word or a capital letter."""
    low = F.lower(name)
    banned = F.lit(False)
    for phrase in NOT_NAMES:
        banned = banned | low.contains(phrase)
    shaped = name.rlike(EVENT_WORDS) | name.rlike("[A-Z].+")
    return F.coalesce(
        (F.trim(name) != "") & ~name.rlike(RELATIVE_TIME) & name.rlike("[A-Za-z0-9]") & ~banned & (~kind.isin("events", "concepts") | shaped), F.lit(False)
    )


def vague(name: Column, kind: Column, places: Column, subject: Column) -> Column:
    """Whether an event or concept needs its subject added: no place or subject in it, and a year or a general word for an event."""
    low = F.lower(name)
    placed = F.coalesce(low.contains(F.lower(subject)), F.lit(False)) | F.exists(places, lambda p: low.contains(F.lower(p)))
    bare = F.trim(name)
    year = bare.rlike(r"^\d{4}$")
    led = bare.rlike(r"^\d{4}\b") & low.rlike(VAGUE_AFTER_YEAR)
    short = low.rlike(VAGUE_WORDS) & (F.size(F.split(bare, r"\s+")) <= 3)
    return kind.isin("events", "concepts") & ~placed & (year | led | short)
