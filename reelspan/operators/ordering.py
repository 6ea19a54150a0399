"""Running numbers over all rows, or over large groups, without one task for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType, StructType

from reelspan.shared import kept


def number_rows(rows: DataFrame, lead: list[str], seq: str, then: tuple[str, ...] = (), name: str = "place", per_range: int = 1 << 16) -> DataFrame:
    """Add ``name``, from 1, in order of the ``lead`` columns, which have few different values, then ``seq``, a number, then the ``then`` columns.

    Rows are numbered inside (lead, range of seq), after the rows of all smaller ones. There are as many ranges as there are
    times ``per_range`` rows, 64 at least; the window over the ranges' counts has so many rows for each value of ``lead``, never the
    rows themselves.
    """
    ranges = F.greatest(F.lit(64), F.ceil(F.count(F.lit(1)) / per_range))
    ends = rows.agg(F.min(seq).alias("_low"), F.max(seq).alias("_high"), ranges.alias("_ranges"))
    share = (F.col(seq).cast("double") - F.col("_low")) / (F.col("_high").cast("double") - F.col("_low") + 1)
    # one row, joined to all
    dealt = rows.join(F.broadcast(ends), F.lit(True)).withColumn("_range", F.coalesce(F.floor(share * F.col("_ranges")), F.lit(-1)))
    counts = dealt.groupBy(*lead, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy(*lead, "_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(c).alias(f"_{c}") for c in lead], F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*lead, "_range").orderBy(seq, *then))
    same = F.col("_range") == F.col("_of")
    for c in lead:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    numbered = dealt.withColumn("_inside", inside).join(before.hint("merge"), same)
    return numbered.select(*rows.columns, (F.col("_before") + F.col("_inside")).cast("int").alias(name))


def leading_number(rows: DataFrame, column: str) -> Column:
    """A number that never falls where ``column`` grows: itself, or the first field of a struct; 0 where that is no whole or decimal number."""
    kind, path = rows.schema[column].dataType, f"`{column}`"
    while isinstance(kind, StructType) and kind.fields:
        path, kind = f"{path}.`{kind.fields[0].name}`", kind.fields[0].dataType
    return (F.col(path) if isinstance(kind, (IntegralType, DecimalType)) else F.lit(0)).cast("double")


def spread(rows: DataFrame, group: str, by: Column) -> Row:
    """low and high of ``by``, most rows of a group, all rows."""
    each = rows.groupBy(group).agg(F.min(by).alias("low"), F.max(by).alias("high"), F.count(F.lit(1)).alias("n"))
    return each.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("n").alias("most"), F.sum("n").alias("all")).first()


def numbered_firsts(rows: DataFrame, group: list[str], order: list[str], same: list[str], by: Column, found: Row, name: str = "place", per_range: int = 1 << 18, per_task: int = 1 << 16) -> DataFrame:
    """Number the rows of each ``group`` from 1 by ``order``, then keep the first of those with the same ``same`` columns.

    ``by`` is a number that never falls along ``order``; a group is dealt to ranges of it, as many as the largest group of
    ``found`` (see :func:`spread`) has times ``per_range`` rows, and tasks are as many as there are times ``per_task`` rows. Inside a range rows are numbered and
    repeated ones go; what stays is written, as the numbers of rows in earlier ranges come from it.
    """
    low, high = found["low"] or 0.0, found["high"] or 0.0
    ranges, tasks = (max(1, -(-(found[c] or 0) // per)) for c, per in (("most", per_range), ("all", per_task)))
    place = F.coalesce(F.floor((by - F.lit(low)) / F.lit(high - low + 1) * F.lit(ranges)), F.lit(-1))
    dealt = rows.withColumn("_range", place).repartition(tasks, *group, "_range")
    inside = Window.partitionBy(*group, "_range").orderBy(*order)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = dealt.select("*", F.row_number().over(inside).alias("_inside"), F.count(F.lit(1)).over(whole).alias("_n"))
    first = F.row_number().over(Window.partitionBy(*group, "_range", *same).orderBy("_inside"))
    some = kept(counted.withColumn("_k", first).where("_k = 1").drop("_k"), "firsts")
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # a range's first row is always among those that stay
    before = some.where("_inside = 1").select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    at = F.col("_range") == F.col("_of")
    for c in group:
        at = at & F.col(c).eqNullSafe(F.col(f"_{c}"))
    numbered = some.join(before.hint("merge"), at).withColumn(name, F.col("_before") + F.col("_inside"))
    once = F.row_number().over(Window.partitionBy(*group, *same).orderBy(name))
    return numbered.withColumn("_k", once).where("_k = 1").select(*rows.columns, name)
