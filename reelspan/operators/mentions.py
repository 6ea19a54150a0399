"""From candidate names in cues to entities with their mentions."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions import names

#: Kinds in the order in which one is taken for a cue's main entity.
KINDS = ("people", "places", "events", "concepts")


def _kind_rank():
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))


def candidates(items: DataFrame) -> DataFrame:
    """Normalised, plausible names of (transcript_id, cue_idx, ms, kind, item_seq, surface, canonical), one per cue and name: the first by kind and order."""
    named = items.withColumn("name", names.normalise(F.col("canonical"))).where(F.col("kind").isin(*KINDS) & (F.col("name") != ""))
    named = named.where(names.plausible(F.col("name"), F.col("kind"))).withColumn("order", _kind_rank())
    first = F.row_number().over(Window.partitionBy("transcript_id", "cue_idx", "name").orderBy("order", "item_seq"))
    return named.withColumn("k", first).where("k = 1").drop("k")


def anchor_windows(cues: DataFrame, span_ms: int = 5000) -> DataFrame:
    """Give every cue the window that it opens or belongs to; a window begins at the first cue ``span_ms`` or more after the one before.

    A cue ``span_ms`` or more after all cues before it begins a window whatever came before, so a transcript is cut there.
    Inside a stretch the anchor depends on the anchor before: a fold over its cue times in the JVM, which
    returns the anchors only, and cues find theirs by the largest anchor that isn't later.
    """
    so_far = Window.partitionBy("transcript_id").orderBy("cue_idx", "ms")
    times = cues.select("transcript_id", F.col("cue_idx").cast("int").alias("cue_idx"), F.col("ms").cast("bigint").alias("ms"))
    apart = F.col("ms") - F.max("ms").over(so_far.rowsBetween(Window.unboundedPreceding, -1)) >= span_ms
    times = times.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("stretch", F.sum("apart").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    rows = times.groupBy("transcript_id", "stretch").agg(F.array_sort(F.collect_list(F.struct("cue_idx", "ms"))).alias("rows"))
    anchors = F.expr(
        f"""aggregate(rows, named_struct('at', cast(null as bigint), 'cues', cast(array() as array<int>)),
              (a, r) -> if(a.at is null or r.ms - a.at >= {span_ms}, named_struct('at', r.ms, 'cues', concat(a.cues, array(r.cue_idx))), a),
              a -> a.cues)"""
    )
    opened = rows.select("transcript_id", F.explode(anchors).alias("cue_idx")).withColumn("anchor", F.col("cue_idx"))
    order = Window.partitionBy("transcript_id").orderBy("cue_idx")
    joined = cues.join(opened.hint("merge"), ["transcript_id", "cue_idx"], "left")
    return joined.withColumn("anchor", F.last("anchor", ignorenulls=True).over(order))


def emit_mentions(cues: DataFrame, items: DataFrame, primaries: DataFrame, span_ms: int = 5000) -> DataFrame:
    """Mentions that pass the gate: per window one main entity, any person or place once, events and concepts only as main.

    The first cue of a window with any candidate always emits its main entity, so that cue is found by a
    minimum and the rest are windows over (transcript, anchor). ``primaries`` has a hint per cue: transcript_id,
    cue_idx, primary.
    """
    found = candidates(items)
    gate = anchor_windows(cues.select("transcript_id", "cue_idx", "ms"), span_ms).select("transcript_id", "cue_idx", "anchor")
    hints = primaries.select("transcript_id", "cue_idx", names.normalise(F.col("primary")).alias("hint"))
    rows = found.join(gate.hint("merge"), ["transcript_id", "cue_idx"]).join(hints.hint("merge"), ["transcript_id", "cue_idx"], "left")
    window = Window.partitionBy("transcript_id", "anchor")
    rows = rows.withColumn("first_cue", F.min("cue_idx").over(window))
    main = Window.partitionBy("transcript_id", "cue_idx").orderBy(F.coalesce(F.col("hint") == F.col("name"), F.lit(False)).desc(), "order", "item_seq")
    rows = rows.withColumn("main", (F.row_number().over(main) == 1) & (F.col("cue_idx") == F.col("first_cue")))
    once = Window.partitionBy("transcript_id", "anchor", "name").orderBy("cue_idx", F.col("main").desc(), "order")
    kept = rows.where(F.col("main") | F.col("kind").isin("people", "places")).withColumn("k", F.row_number().over(once)).where("k = 1")
    return kept.select("transcript_id", "cue_idx", "ms", "name", "surface", "kind", "order", "item_seq", "main")


def merge_by_canonical(mentions: DataFrame) -> DataFrame:
    """One row per transcript and name: first kind, mentions in order, aliases."""
    in_order = F.struct("cue_idx", F.when(F.col("main"), 0).otherwise(1).alias("m"), "order", "item_seq", "ms")
    return mentions.groupBy("transcript_id", "name").agg(
        F.min_by("kind", in_order).alias("entity_type"),
        F.transform(F.array_sort(F.collect_list(in_order)), lambda x: F.struct(x["ms"].alias("ms"), x["cue_idx"].alias("cue_idx"))).alias("occurrences"),
        F.array_sort(F.collect_set("surface")).alias("aliases"),
        F.min(in_order).alias("seq"),
    )


def infer_subjects(items: DataFrame) -> DataFrame:
    """The most frequent place of each transcript over all items, before the gate; ties go to the name."""
    places = items.where("kind = 'places'").withColumn("name", names.normalise(F.col("canonical"))).where("name <> ''")
    counted = places.groupBy("transcript_id", "name").agg(F.count(F.lit(1)).alias("n"))
    best = F.row_number().over(Window.partitionBy("transcript_id").orderBy(F.desc("n"), "name"))
    return counted.withColumn("k", best).where("k = 1").select("transcript_id", F.col("name").alias("subject"), "n")


def add_subjects(entities: DataFrame, subjects: DataFrame) -> DataFrame:
    """Rename vague events and concepts to ``name subject`` and merge those that then share a name."""
    places = F.collect_set(F.when(F.col("entity_type") == "places", F.col("name"))).over(Window.partitionBy("transcript_id"))
    joined = entities.withColumn("places", places).join(subjects.hint("merge"), "transcript_id", "left")
    renamed = F.when(F.col("subject").isNotNull() & names.vague(F.col("name"), F.col("entity_type"), F.col("places"), F.col("subject")), F.concat_ws(" ", "name", "subject")).otherwise(F.col("name"))
    return (
        joined.withColumn("new_name", renamed)
        .groupBy("transcript_id", F.col("new_name").alias("name"))
        .agg(
            F.min_by("entity_type", "seq").alias("entity_type"),
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "occurrences"))), lambda x: x["occurrences"])).alias("occurrences"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"),
        )
    )


def _words(text: Column) -> Column:
    """Lower-case words of a text."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"(?U)[^\w]+", " "), " "), lambda w: w != "")


def _automaton(surfaces: list[str]) -> bytes:
    """An Aho-Corasick automaton over surfaces with a blank at both ends, so that only whole words match."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for s in surfaces:
        automaton.add_word(f" {s} ", s)
    automaton.make_automaton()
    return pickle.dumps(automaton)


def _run_automaton(packed: bytes):
    """For every line of words the surfaces in it, as place of the first word and surface; one pass, whatever their length."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = pickle.loads(packed)
        for lines in batches:
            found = []
            for line in lines:
                hits, at, word = [], 0, 1
                for end, s in sorted((end - len(s) - 1, s) for end, s in automaton.iter(line)) if line else ():
                    word, at = word + line.count(" ", at, end), end
                    hits.append({"at": word, "surface": s})
                found.append(hits)
            yield pd.Series(found)

    return F.pandas_udf(run, "array<struct<at:int,surface:string>>")


def _by_first_word(cues: DataFrame, known: DataFrame) -> DataFrame:
    """Surfaces found by their first word: a word of a cue meets the lengths of the surfaces that begin with it, then the runs of these lengths meet the surfaces."""
    size = F.size(F.split("surface", " "))
    firsts = known.select(F.substring_index("surface", " ", 1).alias("word"), size.alias("size")).groupBy("word").agg(F.collect_set("size").alias("sizes"))
    words = cues.select("*", F.posexplode("words").alias("at", "word")).join(firsts.hint("merge"), "word")
    runs = words.select("*", F.explode("sizes").alias("size")).where(F.col("at") + F.col("size") <= F.size("words"))
    runs = runs.withColumn("surface", F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " "))
    return runs.withColumn("at", F.col("at") + 1).join(known.hint("merge"), "surface").select("transcript_id", "cue_idx", "ms", "at", "surface", "canonical", "kind")


def from_gazetteer(cues: DataFrame, gazetteer: DataFrame, most_bytes: int = 1 << 23) -> DataFrame:
    """Mentions by dictionary: every place where the words of a surface of (surface, canonical, kind) stand in a cue, surfaces of any number of words.

    Cues and surfaces are compared by their lower-case words; overlapping surfaces are all found. The surfaces' bytes are
    counted: up to ``most_bytes`` they become one automaton, built once, that every task runs over its cues; a larger dictionary is
    partitioned by first word and joined. Surfaces without words match nothing; one with several entries gives a row for each.
    """
    lines = cues.select("transcript_id", "cue_idx", F.col("start_ms").alias("ms"), _words(F.col("text")).alias("words"))
    known = gazetteer.select(F.array_join(_words(F.col("surface")), " ").alias("surface"), "canonical", "kind").where("surface <> ''").distinct()
    size = known.agg(F.coalesce(F.sum(F.octet_length("surface") + 2), F.lit(0)).alias("bytes")).first()["bytes"]
    if size > most_bytes:
        return _by_first_word(lines, known)
    surfaces = sorted(r["surface"] for r in known.select("surface").distinct().collect())
    if not surfaces:
        return _by_first_word(lines, known)
    joined = lines.withColumn("line", F.when(F.size("words") > 0, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))))
    found = joined.select("transcript_id", "cue_idx", "ms", F.explode(_run_automaton(_automaton(surfaces))("line")).alias("hit"))
    return found.select("transcript_id", "cue_idx", "ms", "hit.at", "hit.surface").join(F.broadcast(known), "surface").select("transcript_id", "cue_idx", "ms", "at", "surface", "canonical", "kind")
