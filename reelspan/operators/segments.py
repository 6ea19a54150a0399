"""Passages of a transcript: dense, sweeping, listing, step by step; windows and samples of cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.operators.ordering import leading_number, numbered_firsts, spread

# Events with plenty of pictures.
SWEEP_EVENTS = (
    "french revolution", "american revolution", "russian revolution", "industrial revolution", "scientific revolution", "haitian revolution",
    "cuban revolution", "iranian revolution", "chinese revolution", "world war i", "world war ii", "world war 1", "world war 2", "first world war",
    "second world war", "cold war", "vietnam war", "civil war", "napoleonic wars", "crusades", "renaissance", "enlightenment", "reformation",
    "middle ages", "ancient rome", "ancient greece", "roman empire", "british empire", "colonial era", "civil rights movement", "women's suffrage",
    "great depression", "space race", "manhattan project", "age of exploration", "silk road",
)
# Language of lists.
ENUMERATION = (
    r"\b(leaders? like|people like|countries like|nations like)\b",
    r"\b(such as|including|among them|for example)\b.*,.*,",
    r"\b(many|several|numerous|various|countless)\s+(people|leaders|countries|nations|figures|artists|scientists)\b",
    r"\b(across|throughout|around)\s+(the world|europe|asia|africa|america|the globe)\b",
    r"\b(from .+ to .+ to)\b",
    r"\b(\w+,\s+\w+,\s+and\s+\w+)\b",
)
#: What a text must hold for any of these: the same, but of the last one only its middle, without word characters.
_LISTS = (*ENUMERATION[:5], r"\b(and)\s")
# Language of processes, in order of precedence.
PROCESS = {
    "start": (
        r"\b(here'?s how|let me (show|explain|walk)|i'?ll (show|explain|walk))\b",
        r"\b(there are|here are)\s+(\d+|several|a few|some)\s+(steps?|things?|ways?|points?|reasons?)\b",
        r"\b(step (one|1)|first(ly)?|to (start|begin))\b",
        r"\b(the (first|1st) (step|thing|point))\b",
        r"\b(number one|#1)\b",
        r"\b(consider (this|the following)|think about)\b",
    ),
    "end": (
        r"\b(finally|lastly|last(ly)?|in conclusion)\b",
        r"\b(to (summarize|sum up|recap|conclude))\b",
        r"\b(that'?s (it|all|how)|and that'?s)\b",
        r"\b(the (last|final) (step|thing|point))\b",
        r"\b(so (there you have it|that'?s how))\b",
    ),
    "continuation": (
        r"\b(second(ly)?|step (two|2)|next|then|after that)\b",
        r"\b(third(ly)?|step (three|3)|another)\b",
        r"\b(fourth(ly)?|step (four|4)|also)\b",
        r"\b(fifth(ly)?|step (five|5))\b",
        r"\b(number (two|three|four|five|\d+)|#[2-9])\b",
        r"\b(additionally|furthermore|moreover)\b",
        r"\b(and (then|next|finally))\b",
    ),
    "topic_shift": (
        r"\b(now let'?s|moving on|but (first|now)|however)\b",
        r"\b(on (another|a different) note)\b",
        r"\b(switching gears|changing topics?)\b",
        r"\b(anyway|anyhow|at any rate)\b",
    ),
}


def any_of(patterns: tuple[str, ...], flags: str = "(?iU)") -> str:
    """One pattern for several; with (?U) word characters and boundaries are those of Unicode."""
    return flags + "|".join(f"(?:{p})" for p in patterns)


def _branches(pattern: str) -> list[str]:
    """The alternatives that a pattern ``\\b(a|b)rest`` stands for, with ASCII ends: no letter, digit or underscore after a final boundary."""
    body = pattern.removeprefix(r"\b")
    depth, cuts = 0, [0]
    for k, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if depth == 1 and c == "|":
            cuts.append(k)
        if depth == 0:
            cuts.append(k)
            break
    rest = body[cuts[-1] + 1 :]
    rest = (rest.removesuffix(r"\b") + r"(?![a-z0-9_])") if rest.endswith(r"\b") else rest
    return [(body[i + 1 : j] + rest).replace(r"\b", "").replace(r"\s", r"[\s\x85\p{Z}]").replace(r"\d", r"\p{Nd}") for i, j in zip(cuts, cuts[1:], strict=False)]


def _may_match(patterns: tuple[str, ...], text: Column) -> Column:
    """A cheap test that every text with a match passes: alternatives by their first letter, with ASCII boundaries, on lower-cased text.

    An ASCII boundary stands wherever a Unicode one does beside an ASCII letter; alternatives that begin with a sign
    are looked for anywhere. Most words of a text cost one comparison of a letter.
    """
    by_first: dict[str, list[str]] = {}
    for branch in sum(map(_branches, patterns), []):
        by_first.setdefault(branch[0], []).append(branch[1:])
    words = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_first.items() if c.isalnum())
    signs = [f"{c}(?:{'|'.join(rest)})" for c, rest in by_first.items() if not c.isalnum()]
    # letters that fold to ASCII ones, before ``lower`` makes two characters of the first
    plain = F.lower(F.translate(text, "\u0130\u0131\u017f", "iis"))
    return plain.rlike("|".join([rf"\b(?:{words})", *signs]))


_ALL_MARKERS = sum(PROCESS.values(), ())


def _marker(text: Column) -> Column:
    """The first kind of process marker that a text has, or null."""
    kind = F.lit(None).cast("string")
    for k in reversed(PROCESS):
        kind = F.when(text.rlike(any_of(PROCESS[k])), k).otherwise(kind)
    return kind


def process_markers(cues: DataFrame) -> DataFrame:
    """The one kind of process marker of each cue that has any. The full patterns run once, on the few texts that may match."""
    likely = cues.where(_may_match(_ALL_MARKERS, F.col("text")))
    return likely.select("*", F.explode(F.array_compact(F.array(_marker(F.col("text"))))).alias("marker"))


def density_clusters(occ: DataFrame, window_ms: int = 8000, least: int = 3, most_images: int = 5) -> DataFrame:
    """Stretches of ``window_ms`` with ``least`` different entities, none sharing a cue with one before.

    Candidates are a range window; since a range also holds mentions at the same time that come before,
    these are filtered out. Taking or leaving candidates is one fold per transcript over those candidates only,
    inside the JVM: as cues are numbered in order of time, a candidate shares a cue with those taken if it begins at or
    before the last cue taken.
    """
    seq = F.row_number().over(Window.partitionBy("transcript_id").orderBy("ms", "cue_idx"))
    ahead = Window.partitionBy("transcript_id").orderBy("ms").rangeBetween(0, window_ms)
    ranked = occ.withColumn("seq", seq)
    near = F.collect_list(F.struct("seq", "entity", "cue_idx")).over(ahead)
    seen = ranked.withColumn("near", F.filter(near, lambda x: x["seq"] >= F.col("seq")))
    found = seen.select(
        "transcript_id", "seq", "ms", "cue_idx", F.array_sort(F.array_distinct(F.transform("near", lambda x: x["entity"]))).alias("entities"), F.array_max(F.transform("near", lambda x: x["cue_idx"])).alias("last_cue")
    ).where(F.size("entities") >= least)
    rows = found.groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct("seq", "ms", "cue_idx", "entities", "last_cue"))).alias("rows"))
    kept = F.expr(
        """aggregate(rows, named_struct('last', cast(null as int), 'kept', slice(rows, 1, 0)),
             (a, r) -> if(a.last >= r.cue_idx, a, named_struct('last', cast(r.last_cue as int), 'kept', concat(a.kept, array(r)))),
             a -> a.kept)"""
    )
    each = rows.select("transcript_id", F.posexplode(kept).alias("k", "r"))
    return each.select(
        "transcript_id",
        F.format_string("density_%03d", F.col("k") + 1).alias("montage_id"),
        F.col("r.ms").alias("ms"),
        F.col("r.cue_idx").alias("cue_idx"),
        F.col("r.entities").alias("entities"),
        F.least(F.size("r.entities"), F.lit(most_images)).alias("images"),
    )


def _broad(low: Column) -> Column:
    """Whether a lower-case name holds the name of a broad event or is part of one.

    Parts are looked for in all events' names at once, one a line; names of several words only in names with a blank.
    """
    part = F.contains(F.lit("\n".join(SWEEP_EVENTS)), low) & ~low.contains("\n")
    held = lambda names: F.exists(F.array(*[F.lit(s) for s in names]), lambda s: F.contains(low, s))
    holds = F.when(low.contains(" "), held(SWEEP_EVENTS)).otherwise(held([s for s in SWEEP_EVENTS if " " not in s]))
    return part | (F.when(F.char_length(low) >= min(map(len, SWEEP_EVENTS)), holds).otherwise(False))


def sweep_events(entities: DataFrame) -> DataFrame:
    """Entities whose name holds the name of a broad event or is part of one; once each, with four images.

    ``entities`` has transcript_id, entity, first_ms and entity_seq.
    """
    number = F.row_number().over(Window.partitionBy("transcript_id").orderBy("entity_seq", "entity"))
    return entities.where(_broad(F.lower("entity"))).select("transcript_id", "entity", F.format_string("sweep_%03d", number).alias("montage_id"), F.col("first_ms").alias("ms"), F.lit(4).alias("images"))


def enumerations(cues: DataFrame, occ: DataFrame) -> DataFrame:
    """Cues in the language of lists, with the entities mentioned in them."""
    hits = cues.where(_may_match(_LISTS, F.col("text"))).where(F.col("text").rlike(any_of(ENUMERATION)))
    named = occ.groupBy("transcript_id", "cue_idx").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    joined = hits.join(named.hint("merge"), ["transcript_id", "cue_idx"], "left").withColumn("entities", F.coalesce("entities", F.expr("cast(array() as array<string>)")))
    number = F.row_number().over(Window.partitionBy("transcript_id").orderBy("cue_idx"))
    return joined.select(
        "transcript_id",
        F.format_string("enum_%03d", number).alias("montage_id"),
        F.col("start_ms").alias("ms"),
        "cue_idx",
        "entities",
        F.substring("text", 1, 200).alias("text"),
        F.least(F.size("entities") + 1, F.lit(5)).alias("images"),
    )


def montage_union(density: DataFrame, sweep: DataFrame, enum: DataFrame) -> DataFrame:
    """All kinds of montage of a transcript with one running number by time."""
    pick = lambda df, kind, k: df.select("transcript_id", "montage_id", "ms", "images", F.lit(kind).alias("kind"), F.lit(k).alias("order"))
    both = pick(density, "density", 0).unionByName(pick(sweep, "sweep_event", 1)).unionByName(pick(enum, "enumeration", 2))
    number = F.row_number().over(Window.partitionBy("transcript_id").orderBy("ms", "order", "montage_id"))
    return both.withColumn("number", number).drop("order")


def fixed_batches(cues: DataFrame, size: int = 5) -> DataFrame:
    """Batches of ``size`` cues: transcript_id, batch, and the cues' numbers."""
    batch = F.floor((F.row_number().over(Window.partitionBy("transcript_id").orderBy("cue_idx")) - 1) / size).cast("int")
    rows = cues.withColumn("batch", batch).groupBy("transcript_id", "batch").agg(F.array_sort(F.collect_list("cue_idx")).alias("cue_idxs"))
    return rows


def sliding_windows(cues: DataFrame, size: int = 8, step: int = 5, extension: int = 6) -> DataFrame:
    """Windows of ``size`` cues every ``step``, up to ``extension`` cues longer while a process is open.

    A process is open if the last start, end or shift in the window is a start; the window then goes on
    through the next end or shift. Each cue is repeated for its windows only; the next end or shift is a
    window function, so no join of cues with cues is needed.
    """
    whole = Window.partitionBy("transcript_id")
    order = whole.orderBy("cue_idx")
    marked = cues.select("transcript_id", "cue_idx", F.when(_may_match(_ALL_MARKERS, F.col("text")), _marker(F.col("text"))).alias("mark"))
    numbered = marked.select("transcript_id", F.row_number().over(order).alias("rn"), F.count(F.lit(1)).over(whole).alias("n"), "mark")
    closing = F.min(F.when(F.col("mark").isin("end", "topic_shift"), F.col("rn"))).over(whole.orderBy("rn").rowsBetween(1, extension))
    numbered = numbered.withColumn("close", closing)
    first = F.greatest(F.lit(1), F.ceil((F.col("rn") - size) / step) * step + 1).cast("int")
    last = (F.floor((F.col("rn") - 1) / step) * step + 1).cast("int")
    inside = numbered.withColumn("start", F.explode(F.sequence(first, last, F.lit(step)))).where((F.col("rn") >= F.col("start")) & (F.col("rn") < F.col("start") + size))
    windows = inside.groupBy("transcript_id", "start").agg(
        F.max("rn").alias("base_end"), F.max("n").alias("n"), F.max_by("mark", F.when(F.col("mark") != "continuation", F.col("rn"))).alias("state"), F.max_by("close", "rn").alias("close")
    )
    limit = F.least(F.col("base_end") + extension, F.col("n"))
    end = F.when(F.col("state") == "start", F.coalesce("close", limit)).otherwise(F.col("base_end"))
    return windows.select("transcript_id", "start", F.least(end, F.col("n")).cast("int").alias("end"))


def sample_cues(cues: DataFrame) -> DataFrame:
    """About 35 cues of a transcript: the first 15, about ten around the quarters, the last 10; all if there are no more than 35."""
    whole = Window.partitionBy("transcript_id")
    ranked = cues.withColumn("i", F.row_number().over(whole.orderBy("cue_idx")) - 1).withColumn("n", F.count(F.lit(1)).over(whole))
    i, n = F.col("i"), F.col("n")
    middle = i.between(15, n - 11)
    around = F.lit(False)
    for q in (1, 2, 3):
        center = F.floor(n * q / 4)
        around = around | i.between(center - 1, center + 2)
    quarter = middle & around
    more = middle & ~around & (F.abs(i - F.floor(n / 2)) <= 5)
    counted = ranked.withColumn("quarter", quarter).withColumn("more", more)
    have = F.sum(F.col("quarter").cast("int")).over(whole)
    rank = F.sum(F.col("more").cast("int")).over(whole.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    topped = F.col("more") & (F.col("have") + F.col("rank") <= 10)
    keep = (n <= 35) | (i < 15) | (i >= n - 10) | F.col("quarter") | topped
    return counted.withColumn("have", have).withColumn("rank", rank).where(keep).select(*cues.columns)


def worth_showing(elements: DataFrame) -> DataFrame:
    """Elements without quotes marked as not quotable and processes of fewer than two steps; a quote without a mark is quotable."""
    quote = (F.col("element_type") != "quote") | F.coalesce("is_quotable", F.lit(True))
    process = (F.col("element_type") != "process") | (F.coalesce(F.size("steps"), F.lit(0)) >= 2)
    return elements.where(quote & process)


def content_key(kind: Column, first: Column, second: Column) -> Column:
    """What two elements of a kind and cue must share to be the same."""
    return F.when(kind == "quote", F.substring(first, 1, 50)).otherwise(F.concat_ws("\x1f", first, second))


def numbered_elements(elements: DataFrame, per_range: int = 1 << 18) -> DataFrame:
    """Ids ``type_001`` in order of ``seq`` inside a transcript and type; then the first of the elements with the same type, cue and content."""
    keyed = elements.withColumn("content_key", content_key(F.col("element_type"), F.col("first"), F.col("second")))
    by = leading_number(keyed, "seq")
    firsts = numbered_firsts(keyed, ["transcript_id", "element_type"], ["seq"], ["cue_idx", "content_key"], by, spread(keyed, "transcript_id", by), "number", per_range)
    return firsts.select(*elements.columns, F.format_string("%s_%03d", "element_type", "number").alias("element_id"))
