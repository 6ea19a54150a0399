"""Editor markers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marker colours by element type: name and number.
COLORS = {"date": ("BLUE", 9), "quote": ("GREEN", 12), "number": ("YELLOW", 6), "process": ("RED", 2), "comparison": ("PURPLE", 3)}
OTHER_COLOR = ("WHITE", 0)


def color_name(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for k, (n, _) in COLORS.items() for x in (k, n)])
    return F.coalesce(known[F.lower(kind)], F.lit(OTHER_COLOR[0]))


def color_number(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for k, (_, n) in COLORS.items() for x in (k, n)])
    return F.coalesce(known[F.lower(kind)], F.lit(OTHER_COLOR[1]))


def label(kind: Column, first: Column, second: Column, element_id: Column) -> Column:
    """``TYPE: key facts``. first and second: date and event, quote, value and label, title and steps, before and after."""
    has = F.coalesce(second, F.lit("")) != ""
    quote = F.when(F.char_length(first) > 50, F.concat(F.substring(first, 1, 47), F.lit("..."))).otherwise(first)
    return (
        F.when(kind == "date", F.concat(F.lit("DATE: "), first, F.when(has, F.concat(F.lit(" - "), second)).otherwise("")))
        .when(kind == "quote", F.concat(F.lit('QUOTE: "'), quote, F.lit('"')))
        .when(kind == "number", F.concat(F.lit("NUMBER: "), first, F.when(has, F.concat(F.lit(" "), second)).otherwise("")))
        .when(kind == "process", F.concat(F.lit("PROCESS: "), first, F.lit(" ("), second, F.lit(" steps)")))
        .when(kind == "comparison", F.concat(F.lit("COMPARISON: "), first, F.lit(" vs "), second))
        .otherwise(F.concat(F.upper(kind), F.lit(": "), F.coalesce(element_id, F.lit("unknown"))))
    )
