"""Visual elements from model replies, with payloads that keep their types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.operators.ordering import leading_number, numbered_firsts, spread

#: Lists of a reply in the order in which they are read, and the type of element in each.
LISTS = (("numbers", "number"), ("dates", "date"), ("quotes", "quote"), ("processes", "process"), ("comparisons", "comparison"))


def _is_object(value: Column) -> Column:
    """Whether a variant is an object; its schema, which takes longer, isn't asked for."""
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def canonical(value: Column) -> Column:
    """A scalar variant as text that is equal where values are: numbers by value, whatever their type, apart from texts."""
    number = F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return F.when(number, F.concat(F.lit("#"), F.try_variant_get(value, "$", "double").cast("string"))).otherwise(F.to_json(value))


def _field(payload: Column, name: str, default: str = '""') -> Column:
    """A field of a payload as canonical text; where it is missing that of its default."""
    return F.coalesce(canonical(F.try_variant_get(payload, f"$.{name}", "variant")), F.lit(default))


def _items(payload: Column, name: str) -> Column:
    """The items of a list in a payload; none where it is missing or no list."""
    return F.try_variant_get(payload, f"$.{name}", "array<variant>")


def steps(payload: Column) -> Column:
    """How many steps a process has."""
    return F.coalesce(F.size(_items(payload, "steps")), F.lit(0))


def content_key(kind: Column, payload: Column) -> Column:
    """What two elements of a type and cue must share to be the same: title and number of steps, the first 50 characters, value and raw numbers, date and event, before and after."""
    raw = F.to_json(F.transform(F.coalesce(_items(payload, "raw_numbers"), F.array()), canonical))
    text = F.substring(F.coalesce(F.try_variant_get(payload, "$.text", "string"), F.lit("")), 1, 50)
    both = lambda a, b: F.to_json(F.array(a, b))
    return (
        F.when(kind == "process", both(_field(payload, "title"), steps(payload).cast("string")))
        .when(kind == "quote", text)
        .when(kind == "number", both(_field(payload, "value"), raw))
        .when(kind == "date", both(_field(payload, "date"), _field(payload, "event")))
        .when(kind == "comparison", both(_field(payload, "before"), _field(payload, "after")))
        .otherwise(F.substring(F.to_json(payload), 1, 100))
    )


def _shown(kind: Column, payload: Column) -> Column:
    """Quotes marked as not quotable and processes of fewer than two steps are left out; a mark is read as true or false whatever its type."""
    mark = F.to_json(F.try_variant_get(payload, "$.is_quotable", "variant"))
    quotable = ~F.coalesce(mark.isin("false", "null", "0", "0.0", '""', "[]", "{}"), F.lit(False))
    return ((kind != "quote") | quotable) & ((kind != "process") | (steps(payload) >= 2))


def payload_elements(replies: DataFrame) -> DataFrame:
    """(transcript_id, reply_no, reply) -> transcript_id, element_id, element_type, cue_idx, payload (VARIANT), content_key.

    A reply holds one JSON object, lists of items by cue: {"3": {"numbers": [{...}, ...], ...}}. Keys that aren't numbers,
    lists that aren't lists and items that aren't objects are left out; a reply that can't be read gives nothing. Elements
    are numbered by type over the transcript, in order of reply, cue and place, before repeated ones go: the first of a type, cue and
    content stays, as windows overlap.
    """
    spark = replies.sparkSession
    by = leading_number(replies, "reply_no")
    found = spread(replies, "transcript_id", by)
    document = F.try_parse_json(F.regexp_extract("reply", r"(?s)\{.*\}", 0)).alias("document")
    read = replies.select("transcript_id", "reply_no", by.alias("by"), document)
    by_cue = read.lateralJoin(spark.tvf.variant_explode(F.col("document").outer())).select("transcript_id", "reply_no", "by", F.expr("try_cast(key as int)").alias("cue_idx"), F.col("value").alias("lists"))
    # one row an item, not one a list; what is no list or no object has no items
    item = lambda k, kind: lambda x, i: F.struct(F.lit(k).alias("list_no"), F.lit(kind).alias("element_type"), i.alias("item_no"), x.alias("payload"))
    items = [F.coalesce(F.transform(_items(F.col("lists"), plural), item(k, kind)), F.array()) for k, (plural, kind) in enumerate(LISTS)]
    each = by_cue.where("cue_idx is not null").select("transcript_id", "reply_no", "by", "cue_idx", F.inline(F.concat(*items)))
    kind, payload = F.col("element_type"), F.col("payload")
    shown = each.where(_is_object(payload)).where(_shown(kind, payload)).withColumn("content_key", content_key(kind, payload))
    order = ["reply_no", "cue_idx", "list_no", "item_no"]
    firsts = numbered_firsts(shown, ["transcript_id", "element_type"], order, ["cue_idx", "content_key"], F.col("by"), found, "number")
    return firsts.select("transcript_id", F.format_string("%s_%03d", "element_type", "number").alias("element_id"), "element_type", "cue_idx", "payload", "content_key")
