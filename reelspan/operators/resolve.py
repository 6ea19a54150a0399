"""Which names mean the same entity."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from reelspan import shared as shared_tables


@F.pandas_udf(T.DoubleType())
def likeness(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Twice the characters in matching blocks over both lengths; not symmetric. Rows with one second string follow one another, so its index is built once."""
    matcher = SequenceMatcher(None)
    for a, b in batches:
        out = []
        for x, y in zip(a, b, strict=True):
            if matcher.b != y:
                matcher.set_seq2(y)
            matcher.set_seq1(x)
            out.append(matcher.ratio())
        yield pd.Series(out, dtype="float64")


def alike(strings: DataFrame, threshold: float) -> DataFrame:
    """Rows of (a_low, b_low) whose likeness reaches a threshold.

    Bounds decide most rows inside the JVM: the longest block is at least the common opening or ending, and matched
    characters are at most half of both lengths less the edit distance. Only what they leave open is matched block by block.
    """
    a, b = F.col("a_low"), F.col("b_low")
    total = F.char_length(a) + F.char_length(b)
    enough = F.ceil(threshold * total / 2 - 1e-9).cast("int")
    sure = (F.left(a, enough) == F.left(b, enough)) | (F.right(a, enough) == F.right(b, enough))
    near = F.levenshtein(a, b) <= (1 - threshold) * total + 1e-9
    marked = strings.withColumn("sure", sure)
    unsure = marked.where(~F.col("sure") & near).select("a_low", "b_low").sortWithinPartitions("b_low")
    found = unsure.withColumn("ratio", likeness("a_low", "b_low")).where(F.col("ratio") >= threshold)
    return marked.where("sure").select("a_low", "b_low").unionByName(found.select("a_low", "b_low"))


def lookup(wanted: DataFrame, entities: DataFrame) -> DataFrame:
    """Find each wanted (transcript_id, name) among the entities whatever its case; the exact name first, then the earliest."""
    left = wanted.withColumn("low", F.lower("name"))
    right = entities.select("transcript_id", F.col("entity").alias("found"), "entity_seq", F.lower("entity").alias("low"))
    best = F.row_number().over(Window.partitionBy("transcript_id", "name").orderBy((F.col("found") == F.col("name")).desc(), "entity_seq", "found"))
    return left.join(right.hint("merge"), ["transcript_id", "low"]).withColumn("k", best).where("k = 1").drop("k", "low")


_GROUP = ["transcript_id", "entity_type"]


def _name_grams(low: Column) -> Column:
    """Grams of a name as (role, own, gram): role 1 pairs of neighbouring letters and letters, own those that a longer name must share; role 2 letters with a running number."""
    size = F.char_length(low)
    letters = F.filter(F.split(low, ""), lambda c: c != "")
    single = F.array_distinct(letters)
    pairs = F.when(size > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(2))))).otherwise(F.array())
    gram = lambda role, own: lambda g: F.struct(F.lit(role).alias("role"), own.alias("own"), g.alias("gram"))
    # the n-th of a letter is a gram of its own
    counts = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.filter(letters, lambda x: x == c))), lambda n: F.concat(c, n.cast("string")))
    numbered = F.flatten(F.transform(single, counts))
    return F.concat(F.transform(pairs, gram(1, F.lit(True))), F.transform(single, gram(1, size == 1)), F.transform(numbered, gram(2, F.lit(True))))


def similar_pairs(entities: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Ordered pairs of a transcript's entities of one type, one name within the other or alike by ``threshold``.

    Names meet by equality, not all with all, in one join of their grams. A name within another shares its rarest pair of
    letters with it. Names alike by the threshold share as many letters, counted with repeats, as the ratio asks for, so each
    has one of them among its rarest ones, one more than it may lack (a prefix filter); their lengths are in a band that
    the ratio sets. Likeness is by matching blocks, once for each two strings, whatever the transcripts. Blank names are
    left out.
    """
    named = entities.where(F.trim("entity") != "").select(*_GROUP, F.col("entity").alias("name"), F.col("entity_seq").alias("seq"), F.lower("entity").alias("low"))
    grams = named.select("*", F.explode(_name_grams(F.col("low"))).alias("g")).select(*_GROUP, "name", "seq", "low", "g.*")
    grams = grams.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy(*_GROUP, "role", "gram")))
    grams = grams.withColumn("k", F.row_number().over(Window.partitionBy(*_GROUP, "name", "role", "own").orderBy("many", "gram")))
    size = F.char_length("low")
    first = F.col("own") & (F.col("k") <= F.when(F.col("role") == 1, 1).otherwise(size - F.ceil(size * threshold / (2 - threshold) - 1e-9) + 1))
    side = lambda p, rows: rows.select(*_GROUP, "role", "gram", *[F.col(c).alias(f"{p}_{c}") for c in ("name", "seq", "low")])
    met = side("a", grams.where(first)).join(side("b", grams.where((F.col("role") == 1) | first)).hint("merge"), [*_GROUP, "role", "gram"]).where("a_name <> b_name")
    a, b = F.col("a_low"), F.col("b_low")
    inside = met.where((F.col("role") == 1) & F.contains(b, a))
    columns = [*_GROUP, "a_name", "a_seq", "b_name", "b_seq"]
    turned = inside.select(*_GROUP, *[F.col(f"{x}_{c}").alias(f"{y}_{c}") for x, y in (("b", "a"), ("a", "b")) for c in ("name", "seq")])
    band = 2 * F.least(F.char_length(a), F.char_length(b)) >= threshold * (F.char_length(a) + F.char_length(b)) - 1e-9
    maybe = met.where((F.col("role") == 2) & band & ~F.contains(b, a) & ~F.contains(a, b)).select(*columns, "a_low", "b_low").distinct()
    strings = alike(maybe.select("a_low", "b_low").distinct(), threshold)
    passing = maybe.join(strings.hint("merge"), ["a_low", "b_low"], "left_semi")
    return inside.select(*columns).unionByName(turned.select(*columns)).distinct().unionByName(passing.select(*columns))


def fuzzy_clusters(entities: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Greedy clusters: leaders in order, each takes its similar names that are still free; longest name first.

    Pairs are found by a join; taking them in order is a fold per transcript and type over the pairs' leaders.
    """
    pairs = similar_pairs(entities, threshold)
    partners = F.transform(F.array_sort(F.collect_list(F.struct("b_seq", "b_name"))), lambda x: x["b_name"])
    led = pairs.groupBy("transcript_id", "entity_type", "a_name", "a_seq").agg(partners.alias("partners"))
    rows = led.groupBy("transcript_id", "entity_type").agg(F.array_sort(F.collect_list(F.struct("a_seq", "a_name", "partners"))).alias("rows"))
    fold = F.expr(
        """aggregate(rows, named_struct('used', cast(array() as array<string>), 'found', cast(array() as array<array<string>>)),
             (s, r) -> if(array_contains(s.used, r.a_name), s,
                          transform(array(array_except(r.partners, s.used)), free -> if(size(free) = 0, s,
                            named_struct('used', concat(s.used, free, array(r.a_name)), 'found', concat(s.found, array(concat(array(r.a_name), free))))))[0]),
             s -> s.found)"""
    )
    each = rows.select("transcript_id", "entity_type", F.posexplode(fold).alias("cluster", "members"))
    placed = F.array_sort(F.expr("transform(members, (m, i) -> named_struct('l', -length(m), 'i', i, 'm', m))"))
    return each.select("transcript_id", "entity_type", "cluster", F.transform(placed, lambda x: x["m"]).alias("members"))


def dedup_occurrences(occ: DataFrame) -> DataFrame:
    """First mention at each timecode of an entity; mentions without a timecode all stay. ``seq`` is their order."""
    first = F.row_number().over(Window.partitionBy("transcript_id", "entity", "timecode").orderBy("seq"))
    return occ.withColumn("k", first).where((F.col("k") == 1) | (F.coalesce("timecode", F.lit("")) == "")).drop("k")


def merge_clusters(entities: DataFrame, clusters: DataFrame) -> DataFrame:
    """Merge clusters of names into their first member found; also the audit of what was merged.

    ``entities`` has transcript_id, entity, entity_seq, priority, context, aliases and occurrences (structs of
    timecode and cue_idx). A context is added only if the one so far doesn't hold it: a fold over the members.
    """
    wanted = clusters.select("transcript_id", "cluster", F.posexplode("members").alias("at", "name"))
    found = lookup(wanted, entities)
    size = F.count(F.lit(1)).over(Window.partitionBy("transcript_id", "cluster"))
    found = found.withColumn("m", size).where("m >= 2").select("transcript_id", "cluster", "at", F.col("found").alias("entity"))
    rows = found.join(entities.hint("merge"), ["transcript_id", "entity"])
    key = ["transcript_id", "cluster"]
    row = F.struct("at", "entity", "context", "aliases")
    merged = rows.groupBy(*key).agg(F.array_sort(F.collect_list(row)).alias("rows"), F.max("priority").alias("priority"))
    each = rows.select(*key, "at", F.posexplode("occurrences").alias("i", "o")).select(*key, "at", "i", "o.timecode", "o.cue_idx")
    first = F.row_number().over(Window.partitionBy(*key, "timecode").orderBy("at", "i"))
    kept = each.withColumn("k", first).where((F.col("k") == 1) | (F.coalesce("timecode", F.lit("")) == ""))
    unique = kept.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("timecode", "at", "i", "cue_idx"))).alias("kept"))
    context = F.expr(
        """aggregate(rows, cast('' as string), (acc, r) ->
             case when coalesce(r.context, '') = '' or contains(acc, r.context) then acc when acc = '' then r.context else concat(acc, ' | ', r.context) end)"""
    )
    empty = F.expr("cast(array() as array<struct<timecode:string,at:int,i:int,cue_idx:int>>)")
    return (
        merged.join(unique.hint("merge"), key, "left")
        .withColumn("occurrences", F.transform(F.coalesce("kept", empty), lambda x: F.struct(x["timecode"].alias("timecode"), x["cue_idx"].alias("cue_idx"))))
        .select(
            "transcript_id",
            F.col("rows")[0]["entity"].alias("canonical"),
            F.expr("transform(slice(rows, 2, size(rows)), r -> r.entity)").alias("merged_from"),
            F.expr("array_sort(array_distinct(concat(flatten(transform(rows, r -> coalesce(r.aliases, cast(array() as array<string>)))), transform(slice(rows, 2, size(rows)), r -> r.entity))))").alias("aliases"),
            "priority",
            context.alias("context"),
            "occurrences",
            F.size("occurrences").alias("total_occurrences"),
        )
    )


_SEED = 3


def _grams(text: Column, most: Column | int) -> Column:
    """Distinct runs of 1 to ``_SEED`` characters of a text's first ``most``."""
    size = F.least(F.char_length(text), F.lit(most) if isinstance(most, int) else most)
    runs = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array())
    return F.array_distinct(F.concat(*[runs(n) for n in range(1, _SEED + 1)]))


def _words(low: Column) -> Column:
    """Distinct words of a lower-case text."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(low, r"(?U)[^\w]+", " "), " "), lambda w: w != ""))


def _by_seed(own: DataFrame, theirs: DataFrame, inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs where the inner text stands in the outer one, each inner text looked for by that of its seeds which the fewest outer texts have."""
    many = theirs.groupBy("transcript_id", "seed").agg(F.count(F.lit(1)).alias("many"))
    # a seed that no outer text has rules its text out
    known = own.join(many.hint("merge"), ["transcript_id", "seed"], "left").withColumn("many", F.coalesce("many", F.lit(0)))
    rarest = known.groupBy("transcript_id", "inner_id").agg(F.min(F.struct("many", "seed")).alias("seed")).where("seed.many > 0")
    met = rarest.select("transcript_id", "inner_id", "seed.seed").join(theirs.hint("merge"), ["transcript_id", "seed"])
    full = met.join(inner.hint("merge"), ["transcript_id", "inner_id"]).join(outer.hint("merge"), ["transcript_id", "outer_id"])
    return full.where(F.contains("outer", F.col("inner"))).select("transcript_id", "inner_id", "outer_id")


def _contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner_id, outer_id): pairs of a transcript where the one lower-case text stands in the other.

    A word that neither begins nor ends the inner text is a word of every text that holds it, and its seed. Inner texts
    without one are looked for by runs of three characters (the whole text, if it is shorter), in transcripts that have such texts only.
    """
    seeded = inner.withColumn("words", _words(F.regexp_replace("inner", r"(?U)^\w+|\w+$", "")))
    by_word = _by_seed(
        seeded.select("transcript_id", "inner_id", F.explode("words").alias("seed")),
        outer.select("transcript_id", "outer_id", F.explode(_words(F.col("outer"))).alias("seed")),
        inner,
        outer,
    )
    rest = seeded.where(F.size("words") == 0).drop("words")
    near = outer.join(rest.select("transcript_id").distinct().hint("merge"), "transcript_id", "left_semi")
    wanted = F.least(F.char_length("inner"), F.lit(_SEED))
    by_run = _by_seed(
        rest.select("transcript_id", "inner_id", F.explode(F.filter(_grams(F.col("inner"), 1 << 30), lambda g: F.char_length(g) == wanted)).alias("seed")),
        near.select("transcript_id", "outer_id", F.explode(_grams(F.col("outer"), 1 << 30)).alias("seed")),
        rest,
        near,
    )
    return by_word.unionByName(by_run)


def quote_matches(quotes: DataFrame, cues: DataFrame, least: float = 0.3, opening: int = 30, most_ids: int = 1 << 20) -> DataFrame:
    """The cue that holds most of a quote's words; 0.5 more where the quote's opening stands in the cue or the cue in the quote; at least ``least``.

    ``quotes`` has quote_id, transcript_id and quote. Word overlaps come from a join on words. Texts that hold one another are
    found by seeds within the transcript, so they need no word in common. Quotes and the cues of their transcripts
    are kept in the shared folder; up to ``most_ids`` transcripts, counted, are sent to every task to pick the cues, more are joined. A quote of white space
    only stands in every cue, so the first is its match; an empty one, and cues without words, match nothing.
    """
    bare = F.regexp_replace(F.lower("quote"), r"(?U)^\s+|\s+$", "")
    q = quotes.where("quote <> ''").select("quote_id", "transcript_id", bare.alias("low"), _words(F.lower("quote")).alias("words"))
    q = q.withColumn("n", F.greatest(F.size("words"), F.lit(1))).withColumn("opening", F.substring("low", 1, opening))
    q = shared_tables.kept(q, "quotes")
    ids = q.select("transcript_id").distinct()
    asked = cues.join(ids.hint("broadcast" if ids.count() <= most_ids else "merge"), "transcript_id", "left_semi")
    c = asked.select("transcript_id", "cue_idx", F.lower("text").alias("cue_low"), _words(F.lower("text")).alias("cue_words")).where(F.size("cue_words") > 0)
    c = shared_tables.kept(c, "asked")
    shared = (
        q.select("quote_id", "transcript_id", F.explode("words").alias("word"))
        .join(c.select("transcript_id", "cue_idx", F.explode("cue_words").alias("word")).hint("merge"), ["transcript_id", "word"])
        .groupBy("quote_id", "transcript_id", "cue_idx")
        .agg(F.count(F.lit(1)).alias("overlap"), F.lit(False).alias("held"))
    )
    text = q.where("low <> ''")
    opened = _contained(text.select("transcript_id", F.col("quote_id").alias("inner_id"), F.col("opening").alias("inner")), c.select("transcript_id", F.col("cue_idx").alias("outer_id"), F.col("cue_low").alias("outer")))
    within = _contained(c.select("transcript_id", F.col("cue_idx").alias("inner_id"), F.col("cue_low").alias("inner")), text.select("transcript_id", F.col("quote_id").alias("outer_id"), F.col("low").alias("outer")))
    first = q.where("low = ''").join(c.groupBy("transcript_id").agg(F.min("cue_idx").alias("cue_idx")).hint("merge"), "transcript_id")
    held = (
        opened.select(F.col("inner_id").alias("quote_id"), "transcript_id", F.col("outer_id").alias("cue_idx"))
        .unionByName(within.select(F.col("outer_id").alias("quote_id"), "transcript_id", F.col("inner_id").alias("cue_idx")))
        .unionByName(first.select("quote_id", "transcript_id", "cue_idx"))
        .select("*", F.lit(0).cast("long").alias("overlap"), F.lit(True).alias("held"))
    )
    both = shared.unionByName(held.select(*shared.columns)).groupBy("quote_id", "transcript_id", "cue_idx").agg(F.max("overlap").alias("overlap"), F.max("held").alias("held"))
    scored = both.join(q.select("quote_id", "n").hint("merge"), "quote_id")
    scored = scored.withColumn("score", F.col("overlap") / F.col("n") + F.when(F.col("held"), 0.5).otherwise(0.0)).where(F.col("score") >= least)
    best = F.row_number().over(Window.partitionBy("quote_id").orderBy(F.desc("score"), "cue_idx"))
    return scored.withColumn("k", best).where("k = 1").select("quote_id", "transcript_id", "cue_idx", "score")
