"""Image candidates of an entity: rank, cascade of rules, choice, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions import images as fn


def era_rank(year: Column, era_start: Column, era_end: Column) -> tuple[Column, Column]:
    """(tier, distance): within the era, within 50 years of its middle, otherwise dated, undated."""
    middle = F.floor((era_start + era_end) / 2)
    away = F.abs(year - middle)
    tier = F.when(year.isNull(), 3).when(year.between(era_start, era_end), 0).when(away <= 50, 1).otherwise(2)
    return tier, F.coalesce(away, F.lit(999999))


def age_rank(year: Column, now: int) -> tuple[Column, Column]:
    """(tier, year): thirty years old or more, newer, undated; older first."""
    return F.when(year.isNull(), 2).when(year <= now - 30, 0).otherwise(1), F.coalesce(year, F.lit(999999))


def order_images(images: DataFrame, now: int = 2026) -> DataFrame:
    """Add ``rank`` per entity. ``images`` has entity, entity_type, img_pos, year and the era (both null: none).

    People: newest first, undated last. Names with a year in them: as they come. Others by era, or by age
    without one.
    """
    era_tier, era_away = era_rank(F.col("year"), F.col("era_start"), F.col("era_end"))
    age_tier, age_year = age_rank(F.col("year"), now)
    has_era = F.col("era_start").isNotNull() & F.col("era_end").isNotNull()
    recent = F.col("entity_type") == "people"
    dated = F.size(fn.years(F.col("entity"))) > 0
    tier = F.when(recent, F.col("year").isNull().cast("int")).when(dated, 0).when(has_era, era_tier).otherwise(age_tier)
    key = F.when(recent, -F.coalesce("year", F.lit(0))).when(dated, 0).when(has_era, era_away).otherwise(age_year)
    return images.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy(tier, key, "img_pos")))


def reject_reason(title: Column, has_metadata: Column, url: Column, mime: Column, object_name: Column, description: Column, known: Column) -> Column:
    """The first rule that an image fails, null if it passes all."""
    return (
        F.when(fn.blacklisted(title).isNotNull(), "blacklist_pattern")
        .when(~fn.is_picture(title), "no_image_extension")
        .when(~has_metadata, "no_metadata")
        .when(F.coalesce(url, F.lit("")) == "", "no_url")
        .when(~fn.is_image_mime(mime), "non_image_mime")
        .when(fn.is_sound_or_film(title), "non_image_title")
        .when(fn.symbolic_svg(title, mime, object_name, description), "symbolic_svg")
        .when(known, "already_exists")
    )


def walk(ranked: DataFrame, limit: Column) -> DataFrame:
    """Follow ranked images (entity, rank, reason) until ``limit`` are accepted; later ones are not looked at.

    Adds ``accepted``. The walk stops where the running count of passes reaches the limit, so rows stay whose
    count before them is below it.
    """
    order = Window.partitionBy("entity").orderBy("rank")
    passes = F.col("reason").isNull().cast("int")
    before = F.coalesce(F.sum(passes).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.withColumn("before", before).where(F.col("before") < limit).withColumn("accepted", F.col("reason").isNull()).drop("before")


def image_limit(mentions: Column, montage_images: Column, base: int = 3) -> Column:
    """Images per entity: three mentions or more ask for five, a montage for its own number at least."""
    own = F.when(mentions >= 3, 5).otherwise(base)
    return F.greatest(own, F.coalesce(montage_images, F.lit(0)))


def license_order(images: DataFrame) -> DataFrame:
    """Rank images per entity by license, then by position."""
    return images.withColumn("license_rank", F.row_number().over(Window.partitionBy("entity").orderBy(fn.license_rank(F.col("category")), "img_pos")))


def drop_svg_twins(images: DataFrame) -> DataFrame:
    """Drop an SVG where the entity has a PNG of the same name."""
    base = F.lower(F.regexp_replace("title", r"\.[^.]*$", ""))
    named = images.withColumn("base", base).withColumn("ext", fn.extension(F.col("title")))
    pngs = named.where("ext = 'png'").select("entity", "base").distinct()
    svgs = named.where("ext = 'svg'").join(pngs.hint("merge"), ["entity", "base"], "left_anti").select(named.columns)
    return named.where("ext <> 'svg'").unionByName(svgs).drop("base", "ext")


def dedup_paths(images: DataFrame) -> DataFrame:
    """First image of each path."""
    first = F.row_number().over(Window.partitionBy("transcript_id", "entity", F.lower("path")).orderBy("img_pos"))
    return images.withColumn("k", first).where("k = 1").drop("k")


def svg_siblings(images: DataFrame, files: DataFrame) -> DataFrame:
    """Replace an SVG by the PNG of the same path where ``files`` (path) has it, drop it otherwise; then each path once, the first wins."""
    png = F.regexp_replace("path", r"(?i)\.svg$", ".png")
    drawn = F.lower("path").endswith(".svg")
    known = files.select(F.col("path").alias("png")).distinct()
    swapped = images.where(drawn).withColumn("png", png).join(known.hint("merge"), "png").withColumn("path", F.col("png")).select(images.columns)
    return dedup_paths(images.where(~drawn).unionByName(swapped))


def with_metadata(titles: DataFrame, metadata: DataFrame, redirects: DataFrame) -> DataFrame:
    """Join titles with metadata found under the title itself or the one it redirects to; the title itself first."""
    own = metadata.select(F.col("title"), F.lit(0).alias("via"), F.struct(*[c for c in metadata.columns if c != "title"]).alias("meta"))
    other = redirects.join(metadata.hint("merge"), F.col("to_title") == F.col("title")).select(F.col("from_title").alias("title"), F.lit(1).alias("via"), F.struct(*[F.col(c) for c in metadata.columns if c != "title"]).alias("meta"))
    best = own.unionByName(other).groupBy("title").agg(F.min_by("meta", "via").alias("meta"))
    return titles.join(best.hint("merge"), "title", "left").withColumn("has_metadata", F.col("meta").isNotNull())


def first_source(candidates: DataFrame) -> DataFrame:
    """Images of each entity's first source (smallest ``source_order``) that has any."""
    best = F.dense_rank().over(Window.partitionBy("entity").orderBy("source_order"))
    return candidates.withColumn("k", best).where("k = 1").drop("k")


def thumbnail_url(width: Column, thumb: Column, url: Column) -> Column:
    return F.when(width > 0, F.coalesce(thumb, url)).otherwise(url)


def inject(images: DataFrame, manual: DataFrame) -> DataFrame:
    """Add images by hand, missing fields as defaults, and rank all by license again."""
    last = images.groupBy("entity").agg(F.max("img_pos").alias("last"))
    number = F.row_number().over(Window.partitionBy("entity").orderBy("title"))
    more = manual.join(last.hint("merge"), "entity", "left").withColumn("img_pos", F.coalesce("last", F.lit(0)) + number).drop("last")
    both = images.unionByName(more, allowMissingColumns=True)
    return license_order(both.withColumn("category", F.coalesce("category", F.lit("unknown"))))


def montage_targets(entities: DataFrame, montages: DataFrame) -> DataFrame:
    """Entities with the most images that any of their montages asks for, and whether they have one."""
    best = montages.select("transcript_id", F.explode("entities").alias("entity"), "images").groupBy("transcript_id", "entity").agg(F.max("images").alias("montage_images"))
    return entities.join(best.hint("merge"), ["transcript_id", "entity"], "left").withColumn("is_montage", F.col("montage_images").isNotNull())
