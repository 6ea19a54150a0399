"""The corpus pipeline: language ID, line dedup, near duplicates, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of
``documents`` (the last one adds the mix's figures). Between stages the rows are written as Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm import decontam, langid, linededup, mixing, ngramjoin
from reelspan.llm.scratch import Scratch, temporary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: no text, no letter, or no language with half of the probability. Every row is judged by its own text; rows that repeat an id stay apart."""
    model = langid.learn(docs, F.lit(True))
    found = langid.identify(docs.select(COLUMNS), model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten documents or more go from all but the one with the smallest doc_id; documents with nothing left go too."""
    found = linededup.drop_frequent_lines(docs.select(COLUMNS), min_docs=10, min_chars=1, keep_one=True)
    kept = found.select("row.doc_id", F.col("kept").alias("text"), "row.lang", "row.source", F.char_length("kept").cast("long").alias("n_chars"))
    return kept.where(F.btrim("text", F.lit(linededup.BLANKS)) != "")


def _row_key() -> Column:
    """64 bits of doc_id and text: rows that share an id but not the text are documents of their own."""
    return F.xxhash64("doc_id", "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays, the one with the smallest doc_id (null last; of one id the smallest row key).

    Rows are told apart by doc_id and text. Of rows equal in both one stays, with the smallest of the other
    columns. Texts without words are linked with nothing, so each id keeps one of them.
    """
    keyed = docs.select(*COLUMNS, _row_key().alias("key"))
    groups = ngramjoin.jaccard_components(keyed.select(F.col("key").alias("doc_id"), "text"))
    groups = groups.select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")).distinct()
    ids = keyed.select("key", "doc_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    first = groups.join(ids.hint("merge"), "key").groupBy("component").agg(F.min(order).alias("first"))
    first = Scratch(spark, "first").write(first.select(F.col("first.key").alias("key")), "first")
    kept = keyed.join(first.hint("merge"), "key", "left_semi").groupBy("key").agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("row"))
    return kept.select(*[f"row.{c}" for c in COLUMNS])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to a fifth of its words edited, go; rows are told apart by doc_id and text."""
    keyed = docs.select(*COLUMNS, _row_key().alias("key"))
    leaks = decontam.find_leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["key"])
    leaks = Scratch(spark, "leaks").write(leaks.select("row.key").distinct(), "leaks")
    return keyed.join(leaks.hint("merge"), "key", "left_anti").select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes; documents of which it takes none go. Rows that repeat an id are documents of their own."""
    taken = mixing.mix_sources(docs)
    return taken.where("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken", "epochs")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: Language ID, the first stage, can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with temporary(spark):
            before, docs = docs, scratch.write(stage(spark, docs, sf_dir), name)
        if hasattr(before, "_scratch_path"):
            scratch.drop(before)
    return docs
