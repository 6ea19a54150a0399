"""Rows on their way through a Python stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered(docs: DataFrame, keep: list[str] | None = None, **extra: Column) -> tuple[DataFrame, str]:
    """The ``keep`` columns (all by default) as c0, c1, ..., so that no name can clash, the text once, and extra columns; also the text's name."""
    names = keep or docs.columns
    text = [] if "text" in names else [F.col("text").alias("text")]
    own = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]
    return docs.select(*own, *text, *[c.alias(n) for n, c in extra.items()]), f"c{names.index('text')}" if "text" in names else "text"


def with_row(found: DataFrame, docs: DataFrame, keep: list[str] | None, *added: str | Column) -> DataFrame:
    """``row``, a struct of the kept columns under their own names, and what was added."""
    names = keep or docs.columns
    return found.select(F.struct(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)]).alias("row"), *added)
