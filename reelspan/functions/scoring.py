"""Scores and levels of entities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of entity types, and of any other type.
TYPE_WEIGHTS = {"people": 1.0, "events": 0.9, "organizations": 0.7, "concepts": 0.6, "places": 0.3}
OTHER_WEIGHT = 0.5
MOST_PRIORITY = 1.2
# Order of match qualities.
QUALITY_LEVELS = {"none": 0, "low": 1, "medium": 2, "high": 3}


def type_weight(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in TYPE_WEIGHTS.items() for x in pair])
    return F.coalesce(known[kind], F.lit(OTHER_WEIGHT))


def mention_multiplier(n: Column) -> Column:
    return F.when(n <= 1, 1.0).when(n == 2, 1.3).when(n == 3, 1.5).otherwise(1.6)


def position_multiplier(first_ms: Column, duration_ms: Column) -> Column:
    """1.1 in the first fifth, its end included; a transcript without length counts as all early."""
    return F.when((duration_ms <= 0) | (first_ms * 5 <= duration_ms), 1.1).otherwise(1.0)


def priority(kind: Column, mentions: Column, first_ms: Column, duration_ms: Column) -> Column:
    """0 without a mention, else weight x mentions x position, at most 1.2, to three places."""
    raw = type_weight(kind) * mention_multiplier(mentions) * position_multiplier(first_ms, duration_ms)
    return F.when(mentions < 1, 0.0).otherwise(F.round(F.least(raw, F.lit(MOST_PRIORITY)), 3))


def match_quality(confidence: Column) -> Column:
    return F.when(confidence >= 7, "high").when(confidence >= 4, "medium").when(confidence >= 1, "low").otherwise("none")


def quality_level(quality: Column) -> Column:
    """Level of a quality; none at all counts as high, an unknown word as the lowest."""
    known = F.create_map(*[F.lit(x) for pair in QUALITY_LEVELS.items() for x in pair])
    return F.coalesce(known[F.coalesce(quality, F.lit("high"))], F.lit(0))


def confidence_action(confidence: Column) -> Column:
    return F.when(confidence >= 7, "download").when(confidence >= 4, "flag").otherwise("skip")


def placement_budget(mentions: Column, pervasive: Column, score: Column, most: int = 3, pervasive_most: int = 2) -> Column:
    """How many mentions of an entity get a place on the timeline."""
    return (
        F.when(mentions <= 1, F.lit(1))
        .when(pervasive | (mentions >= 10), F.least(F.lit(pervasive_most), mentions))
        .when(score >= 0.8, F.least(F.lit(most), mentions))
        .when(score >= 0.5, F.least(F.lit(max(most - 1, 1)), mentions))
        .otherwise(F.lit(1))
        .cast("int")
    )


def skip_reason(kind: Column, score: Column, mentions: Column, first_ms: Column, duration_ms: Column, least: float) -> Column:
    """Why an entity is left out, null if it is kept.

    People and events stay; places stay if first mentioned in the first tenth or twice at least; concepts
    need 0.7 and the common minimum. A minimum of 0 or less keeps everything.
    """
    if least <= 0:
        return F.lit(None).cast("string")
    early = (duration_ms <= 0) | (first_ms * 10 <= duration_ms)
    two = lambda x: F.format_number(x, 2)  # noqa: E731  half goes by the exact binary value, as in C's printf
    return (
        F.when(F.lower(kind).isin("people", "events"), None)
        .when((F.lower(kind) == "places") & (early | (mentions >= 2)), None)
        .when((F.lower(kind) == "places") & (score < least), F.concat(F.lit("place with "), mentions, F.lit(" mention(s), not in first 10%")))
        .when((F.lower(kind) == "concepts") & (score < 0.7), F.concat(F.lit("concept priority "), two(score), F.lit(" < 0.70")))
        .when(score < least, F.concat(F.lit("priority "), two(score), F.lit(f" < {least:.2f}")))
    )


# Names that are never entities.
REJECTED_NAMES = (
    "he", "she", "it", "they", "him", "her", "them", "his", "hers", "its", "i", "me", "my", "mine", "we", "us", "our", "ours", "you", "your", "yours",
    "unknown", "someone", "something", "anyone", "anything", "one", "ones", "man", "woman", "person", "people", "thing", "things", "stuff",
    "somebody", "anybody", "nobody", "everyone", "everything", "a", "an", "the", "this", "that", "these", "those", "here", "there", "now", "then",
    "today", "yesterday", "tomorrow",
)


def rejected_name(name: Column) -> Column:
    return F.lower(F.trim(name)).isin(*REJECTED_NAMES)
