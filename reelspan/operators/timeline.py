"""Clips on tracks: expansion, track assignment, gaps, fillers, registries and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.operators.ordering import number_rows

#: The first track that clips may take; the one below holds the main video.
BASE_TRACK = 2


def ranked_images(images: DataFrame, rank: Column) -> DataFrame:
    """Images of each entity as one array in order of ``rank``: entity, images (bounded by the entity's image limit)."""
    return images.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col("image").alias("image")))), lambda x: x["image"]).alias("images"))


def expand_montage(mentions: DataFrame, pool: DataFrame, clip_frames: int, images: int = 5) -> DataFrame:
    """The k-th image at frame + k clips, for entities with two images at least."""
    n = F.least(F.lit(images), F.size("images"))
    joined = mentions.join(pool.hint("merge"), "entity").where(F.size("images") >= 2)
    each = joined.select(*mentions.columns, n.alias("n"), F.posexplode(F.slice("images", F.lit(1), n)).alias("k", "image"))
    return each.withColumn("frame", F.col("frame") + F.col("k") * clip_frames)


def expand_stacks(mentions: DataFrame, pool: DataFrame, candidates: int = 3) -> DataFrame:
    """``candidates`` images (0: all) of each mention at one frame, with the stack's key, size and the place in it."""
    n = F.size("images") if candidates == 0 else F.least(F.lit(candidates), F.size("images"))
    joined = mentions.join(pool.hint("merge"), "entity").where(F.size("images") >= 1)
    each = joined.select(*mentions.columns, n.alias("stack_size"), F.posexplode(F.slice("images", F.lit(1), n)).alias("stack_offset", "image"))
    return each.withColumn("stack_group", F.when(F.col("stack_size") > 1, F.concat_ws("@", "entity", "frame", "occ_idx")))


def stack_height(available: Column, candidates: int, tracks: int) -> Column:
    """How many images of an entity a filler stacks: 0 leaves an entity with fewer than two out, unless one is asked for."""
    if candidates == 1:
        return F.lit(1)
    target = available if candidates == 0 else F.least(F.lit(candidates), available)
    return F.when(available < 2, 0).otherwise(F.least(target, F.lit(tracks)))


def grown_tracks(clips: DataFrame, tracks: int) -> DataFrame:
    """Per transcript the number of tracks, at least its largest stack."""
    return clips.groupBy("transcript_id").agg(F.greatest(F.lit(tracks), F.max("stack_size")).cast("int").alias("tracks"))


def assign_tracks(clips: DataFrame, tracks: int = 4, duration: int = 100, gap: int = 50, montage_frames: str | None = None) -> DataFrame:
    """Place clips on tracks in order of frame; each transcript by itself, as one fold over its stacks inside the JVM.

    A stack (clips of one ``stack_group``) takes the first block of neighbouring tracks that has been free for ``gap``: the fold's
    state is when each track becomes free, and a sliding maximum over it finds the block. Its first image is on the
    highest track. A single clip that finds none takes the track that is free first, without a gap; others are
    returned with a reason. A column named by ``montage_frames`` gives montage clips their own length; they need a quarter of
    the gap. A transcript has as many tracks as its largest stack needs.
    """
    own = F.coalesce(F.col(montage_frames).cast("bigint"), F.lit(duration)) if montage_frames else F.lit(duration).cast("bigint")
    room = F.when(F.col(montage_frames).isNotNull(), gap // 4).otherwise(gap) if montage_frames else F.lit(gap)
    place = F.struct(F.col("frame").cast("bigint").alias("frame"), F.col("clip_seq").cast("bigint").alias("clip_seq"), F.col("stack_offset").cast("int").alias("stack_offset"))
    single = F.concat(F.lit("#"), F.coalesce(F.col("clip_seq").cast("string"), F.lit("")), F.lit("/"), F.coalesce(F.col("stack_offset").cast("string"), F.lit("")))
    keyed = clips.withColumn("stack_key", F.coalesce(F.concat(F.lit("="), "stack_group"), single)).withColumn("clip_frames", own).withColumn("clip_gap", room).withColumn("clip_place", place)
    stack = F.struct(
        F.min("clip_place").alias("at"),
        F.min_by("frame", "clip_place").cast("bigint").alias("start"),
        F.count(F.lit(1)).cast("int").alias("size"),
        F.min_by("clip_frames", "clip_place").alias("length"),
        F.min_by("clip_gap", "clip_place").cast("bigint").alias("gap"),
    )
    stacks = keyed.groupBy("transcript_id", "stack_key").agg(stack.alias("stack"), F.max("stack_size").alias("widest"))
    count = F.greatest(F.lit(tracks), F.max("widest"), F.max("stack.size"))
    rows = stacks.groupBy("transcript_id").agg(count.cast("int").alias("count"), F.array_sort(F.collect_list(F.struct("stack.at", "stack.start", "stack.size", "stack.length", "stack.gap", "stack_key"))).alias("rows"))
    block = "array_position(transform(sequence(1, count - r.size + 1), k -> array_max(slice(s.free, k, r.size)) + r.gap <= r.start), true)"
    early = "if(r.size = 1 and r.start >= array_min(s.free), array_position(s.free, array_min(s.free)), 0)"
    fold = F.expr(
        f"""aggregate(rows, named_struct('free', array_repeat(cast(0 as bigint), count), 'picked', cast(array() as array<int>)),
              (s, r) -> transform(array(cast(if({block} > 0, {block}, {early}) as int)), room -> named_struct(
                'free', if(room = 0, s.free, transform(s.free, (e, i) -> if(i + 1 between room and room + r.size - 1, r.start + r.length, e))),
                'picked', concat(s.picked, array(room))))[0],
              s -> s.picked)"""
    )
    each = rows.withColumn("picked", fold).select("transcript_id", F.explode(F.arrays_zip("rows", "picked")).alias("z"))
    found = each.select("transcript_id", F.col("z.rows.stack_key").alias("stack_key"), F.col("z.rows.size").alias("size"), F.col("z.rows.length").alias("length"), F.col("z.picked").alias("room"))
    inside = F.row_number().over(Window.partitionBy("transcript_id", "stack_key").orderBy("stack_offset", "clip_place"))
    placed = keyed.withColumn("inside", inside).join(found.hint("merge"), ["transcript_id", "stack_key"])
    reason = F.when(F.col("room") == 0, F.when(F.col("size") == 1, "tracks occupied").otherwise("no block of tracks free"))
    track = F.when(F.col("room") > 0, BASE_TRACK - 1 + F.col("room") + F.col("size") - F.col("inside")).cast("int")
    return placed.select("transcript_id", "entity", "occ_idx", "image", "frame", "clip_seq", "stack_offset", track.alias("track"), reason.alias("skip_reason"), F.col("length").cast("int").alias("duration_frames"))


def assign_single(clips: DataFrame, tracks: int = 4, duration: int = 100, gap: int = 50) -> DataFrame:
    """The same for clips without stacks, as a fold over a transcript's clips inside the JVM."""
    rows = clips.groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct(F.col("frame").cast("bigint").alias("frame"), F.col("clip_seq").cast("bigint").alias("clip_seq")))).alias("rows"))
    spare = f"array_position(transform(s.free, e -> r.frame >= e + {gap}), true)"
    early = "if(r.frame >= array_min(s.free), array_position(s.free, array_min(s.free)), 0)"
    pick = f"cast(if({spare} > 0, {spare}, {early}) as int)"
    fold = F.expr(
        f"""aggregate(rows, named_struct('free', array_repeat(cast(0 as bigint), {tracks}), 'tracks', cast(array() as array<int>)),
              (s, r) -> named_struct('free', transform(s.free, (e, i) -> if(i + 1 = {pick}, r.frame + {duration}, e)), 'tracks', concat(s.tracks, array({pick}))),
              s -> s.tracks)"""
    )
    each = rows.withColumn("picked", fold).select("transcript_id", F.explode(F.arrays_zip("rows", "picked")).alias("z"))
    placed = each.select("transcript_id", F.col("z.rows.clip_seq").alias("clip_seq"), F.col("z.picked").alias("picked"))
    return clips.join(placed.hint("merge"), ["transcript_id", "clip_seq"]).withColumn("track", F.when(F.col("picked") > 0, F.col("picked") + BASE_TRACK - 1)).withColumn("duration_frames", F.lit(duration)).drop("picked")


def gaps(placements: DataFrame, totals: DataFrame, tracks: int) -> DataFrame:
    """Free stretches of every track: before, between and after its clips.

    Each gap ends at the next clip or at the transcript's ``total_frames``; it begins at the end of the clip
    just before, which need not be the latest end. A track without clips is one gap.
    """
    order = Window.partitionBy("transcript_id", "track").orderBy("frame")
    end = F.col("frame") + F.col("duration_frames")
    inner = placements.select("transcript_id", "track", F.coalesce(F.lag(end).over(order), F.lit(0)).alias("gap_start"), F.col("frame").alias("gap_end"), F.lag("frame").over(order).alias("prev_frame"), F.lag("duration_frames").over(order).alias("prev_duration"))
    last = placements.groupBy("transcript_id", "track").agg(F.max_by(end, "frame").alias("gap_start"), F.max("frame").alias("prev_frame"), F.max_by("duration_frames", "frame").alias("prev_duration"))
    every = totals.select("transcript_id", "total_frames", F.explode(F.sequence(F.lit(BASE_TRACK), F.lit(BASE_TRACK + tracks - 1))).alias("track"))
    tail = every.join(last.hint("merge"), ["transcript_id", "track"], "left").select("transcript_id", "track", F.coalesce("gap_start", F.lit(0)).alias("gap_start"), F.col("total_frames").alias("gap_end"), "prev_frame", "prev_duration")
    return inner.unionByName(tail).where("gap_end > gap_start")


def fill_gaps(placements: DataFrame, totals: DataFrame, pool_size: int, tracks: int, duration: int, gap: int, stretch_below: int) -> tuple[DataFrame, DataFrame]:
    """(stretched placements, fillers): short gaps lengthen the clip before, long ones get clips from the pool in turn.

    How many fillers a gap takes has a closed form, so the cursor into the pool is a running sum over tracks
    and gaps; nothing is sequential. The cursor's sum is per transcript over its gaps.
    """
    found = gaps(placements, totals, tracks)
    stretch = (F.col("gap_end") - F.col("gap_start") < stretch_below) & F.col("prev_frame").isNotNull()
    longer = found.where(stretch).select("transcript_id", "track", F.col("prev_frame").alias("frame"), (F.col("gap_end") - gap - F.col("prev_frame")).alias("reach"))
    stretched = placements.join(longer.hint("merge"), ["transcript_id", "track", "frame"], "left").withColumn("duration_frames", F.greatest("duration_frames", F.coalesce("reach", F.lit(0))).cast("int")).drop("reach")
    room = F.when(F.col("prev_frame").isNull(), F.col("gap_end")).otherwise(F.col("gap_end") - gap) - F.col("gap_start") - duration
    wanted = found.where(~stretch).withColumn("m", F.when(room >= 0, F.floor(room / (duration + gap)) + 1).otherwise(0).cast("int")).where("m > 0")
    cursor = Window.partitionBy("transcript_id").orderBy("track", "gap_start").rowsBetween(Window.unboundedPreceding, -1)
    each = wanted.withColumn("base", F.coalesce(F.sum("m").over(cursor), F.lit(0))).select("transcript_id", "track", "gap_start", "base", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("k"))
    fillers = each.select("transcript_id", "track", (F.col("gap_start") + F.col("k") * (duration + gap)).alias("frame"), ((F.col("base") + F.col("k")) % pool_size).alias("pool_no"), F.lit(duration).alias("duration_frames"))
    return stretched, fillers


def _lengthened(placements: DataFrame, totals: DataFrame, gap: int, stretch_below: int) -> DataFrame:
    """Clips that reach to ``gap`` before the next clip of their track, or the end, where what is free after them is short."""
    order = Window.partitionBy("transcript_id", "track").orderBy("frame")
    known = placements.join(totals.select("transcript_id", "total_frames").hint("merge"), "transcript_id")
    upto = F.coalesce(F.lead("frame").over(order), F.col("total_frames"))
    free = upto - (F.col("frame") + F.col("duration_frames"))
    reach = F.when((free > 0) & (free < stretch_below), F.greatest("duration_frames", upto - gap - F.col("frame"))).otherwise(F.col("duration_frames"))
    return known.select("transcript_id", "track", "frame", reach.cast("int").alias("duration_frames"))


def _free_heights(slots: DataFrame, placements: DataFrame, tracks: int, duration: int, gap: int) -> DataFrame:
    """(transcript_id, at, height): how many tracks from the lowest up are free for a clip at ``at``, with a gap on both sides.

    On each track slots and clips are ordered together; a clip that begins before the slot's end is in the way if the latest end so far
    is after its begin.
    """
    every = slots.select("transcript_id", "at", F.explode(F.sequence(F.lit(BASE_TRACK), F.lit(BASE_TRACK + tracks - 1))).alias("track"))
    asked = every.select("transcript_id", "track", (F.col("at") + duration + gap).alias("key"), F.lit(0).alias("clip"), "at", F.lit(None).cast("long").alias("end"))
    theirs = placements.select("transcript_id", "track", F.col("frame").alias("key"), F.lit(1).alias("clip"), F.lit(None).cast("long").alias("at"), (F.col("frame") + F.col("duration_frames")).alias("end"))
    before = Window.partitionBy("transcript_id", "track").orderBy("key", "clip").rowsBetween(Window.unboundedPreceding, -1)
    seen = asked.unionByName(theirs).withColumn("latest", F.max("end").over(before)).where("clip = 0")
    busy = F.when(F.col("latest") + gap > F.col("at"), F.col("track") - BASE_TRACK)
    return seen.groupBy("transcript_id", "at").agg(F.coalesce(F.min(busy), F.lit(tracks)).cast("int").alias("height"))


def fill_gaps_stacked(placements: DataFrame, totals: DataFrame, pool: list[tuple[str, int]], tracks: int, candidates: int, duration: int, gap: int, stretch_below: int) -> DataFrame:
    """Lengthen clips over short gaps on all tracks, then fill the lowest track's gaps with stacks of one entity's images.

    ``pool`` has (entity, number of images) in turn. Places for fillers follow one another by a clip and a gap, so
    no filler is in another's way, and how many tracks are free at each is known beforehand. What depends on the choices before is
    whose turn it is: at each place the first entity in turn whose stack fits. That is a fold over a transcript's
    places, inside the JVM. A transcript without clips is one gap.
    """
    longer = _lengthened(placements, totals, gap, stretch_below)
    base = longer.where(F.col("track") == BASE_TRACK)
    holes = gaps(base, totals, 1)
    room = F.col("gap_end") - gap - F.col("gap_start") - duration
    at = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor(room / (duration + gap))), lambda k: F.col("gap_start") + k * (duration + gap)))
    slots = holes.where(room >= 0).select("transcript_id", at.alias("at"))
    places = _free_heights(slots, longer, tracks, duration, gap).where("height > 0")
    known = [F.struct(F.lit(n).alias("entity"), F.lit(h).cast("int").alias("size")) for n, h in ((n, _height(k, candidates, tracks)) for n, k in pool)]
    if not known:
        return longer.select("*", F.lit(None).cast("string").alias("filler"), F.lit(None).cast("int").alias("stack_offset"))
    count = len(known)
    rows = places.groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct("at", "height"))).alias("rows")).withColumn("pool", F.array(*known))
    # the entity whose turn it is first among those that fit, as how many turns on it is
    fits = f"array_position(transform(sequence(0, {count - 1}), k -> pool[(s.turn + k) % {count}].size between 1 and r.height), true)"
    fold = F.expr(
        f"""aggregate(rows, named_struct('turn', 0, 'picked', cast(array() as array<int>)),
              (s, r) -> transform(array(cast({fits} as int)), n -> named_struct(
                'turn', if(n = 0, s.turn, (s.turn + n) % {count}), 'picked', concat(s.picked, array(if(n = 0, -1, (s.turn + n - 1) % {count})))))[0],
              s -> s.picked)"""
    )
    each = rows.withColumn("picked", fold).select("transcript_id", "pool", F.explode(F.arrays_zip("rows", "picked")).alias("z")).where("z.picked >= 0")
    chosen = each.select("transcript_id", F.col("z.rows.at").alias("frame"), F.expr("pool[z.picked]").alias("who"))
    offset = chosen.select("transcript_id", "frame", F.col("who.entity").alias("filler"), F.col("who.size").alias("size"), F.explode(F.sequence(F.lit(0), F.col("who.size") - 1)).alias("stack_offset"))
    fillers = offset.select("transcript_id", (BASE_TRACK - 1 + F.col("size") - F.col("stack_offset")).cast("int").alias("track"), "frame", F.lit(duration).alias("duration_frames"), "filler", "stack_offset")
    return longer.select("*", F.lit(None).cast("string").alias("filler"), F.lit(None).cast("int").alias("stack_offset")).unionByName(fillers)


def _height(available: int, candidates: int, tracks: int) -> int:
    """The number of images in a stack, as :func:`stack_height`; one with more than there are tracks never fits."""
    if candidates == 1:
        return 1
    return 0 if available < 2 else min(candidates or available, available, tracks)


def filler_pool(entities: DataFrame, pervasive: DataFrame) -> DataFrame:
    """Order of entities for fillers: those listed as pervasive first (name for name, in the list's order), then by priority."""
    listed = pervasive.select("entity", "place").join(entities.hint("merge"), "entity").select("entity", F.lit(0).alias("part"), F.col("place").cast("double").alias("key"), "entity_seq")
    rest = entities.join(pervasive.select("entity").hint("merge"), "entity", "left_anti").select("entity", F.lit(1).alias("part"), (-F.col("priority")).alias("key"), "entity_seq")
    numbered = number_rows(listed.unionByName(rest), ["part", "key"], "entity_seq", ("entity",), name="pool_no")
    return numbered.select("entity", (F.col("pool_no") - 1).alias("pool_no"))


def coverage(placements: DataFrame, totals: DataFrame, tracks: int) -> DataFrame:
    """Share of all tracks' frames that clips take, in thousandths, and how many entities and clips there are."""
    used = placements.groupBy("transcript_id").agg(F.sum("duration_frames").alias("used"), F.count(F.lit(1)).alias("clips"))
    joined = totals.join(used.hint("merge"), "transcript_id", "left")
    share = F.floor(F.coalesce("used", F.lit(0)) * 1000 / (F.col("total_frames") * tracks)).cast("bigint")
    return joined.select("transcript_id", "total_frames", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("clips", F.lit(0)).alias("clips"), F.when(F.col("total_frames") > 0, share).otherwise(0).alias("coverage"))


def within_bounds(clips: DataFrame, low: int, high: int) -> DataFrame:
    """Planned clips that lie inside the timeline."""
    return clips.where((F.col("frame") >= low) & (F.col("frame") + F.col("duration_frames") <= high))


def append_clips(clips: DataFrame, base: int, duration: int, gap: int, most: int) -> DataFrame:
    """One clip after another from ``base``, a gap between, none ending beyond ``base + most``."""
    rank = F.row_number().over(Window.partitionBy("transcript_id").orderBy("clip_seq")) - 1
    return clips.withColumn("position", F.lit(base) + rank * (duration + gap)).where(F.col("position") + duration <= base + most)


def media_registry(placements: DataFrame) -> DataFrame:
    """Every image once per transcript, with the duration of its first placement."""
    first = F.row_number().over(Window.partitionBy("transcript_id", "image").orderBy("track", "frame", "clip_seq"))
    return placements.withColumn("k", first).where("k = 1").select("transcript_id", "image", "duration_frames")


def sequence_header(placements: DataFrame, fps: int) -> DataFrame:
    """Length of each timeline: its last clip's end and ten seconds."""
    return placements.groupBy("transcript_id").agg((F.max(F.col("frame") + F.col("duration_frames")) + 10 * fps).alias("length"))
