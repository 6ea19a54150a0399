"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontam, langid, licenses, linededup, minhash, mixing, neighbours, ngramjoin, prefixtrie, quality, toxicity
from .scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_frequent_lines(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, _table(spark, sf_dir, "labels"), ~_held_out(3, 1))
    found = quality.score_quality(docs, model, keep=["doc_id"]).select("row.doc_id", "score")
    return found.select("doc_id", _held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"], every_place=True)
    return found.select("row.doc_id", "item_id", "first_word", "n_words", "edits")


def _held_out(modulus: int, remainder: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus == remainder


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs, ~_held_out(3, 1))
    found = langid.identify(docs, model, keep=["doc_id"]).select("row.doc_id", "lang_pred", "score")
    return found.select("doc_id", _held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"), ~_held_out(5, 0))
    found = toxicity.score_toxicity(docs, model, keep=["doc_id"]).select("row.doc_id", "score")
    return found.select("doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transcripts out of ``conversations``; the model learns from those whose crc32 is not 1 modulo 3, the others are held out."""
    held_out = lambda c: F.crc32(F.col(c).cast("string")) % 3 == 1
    lines = Scratch(spark, "transcripts").write(chat.observe(chat.raw_transcripts(_table(spark, sf_dir, "conversations"))), "lines")
    model = chat.learn(lines.where(~held_out("conv")))
    return chat.render(chat.decode(lines.drop("state"), model)).select("conv_id", held_out("conv_id").alias("held_out"), "turn", "role", "rendered")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = Scratch(spark, "turns").write(prefixtrie.ordered_turns(_table(spark, sf_dir, "conversations")), "turns")
    nodes = prefixtrie.prefix_trie(prefixtrie.shared_openings(turns), turns.where("at = 1").select("conv_id"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_components(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


NEAREST_SQL = """
WITH good AS (
  SELECT row_number() OVER () AS row, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id,
         sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality": op3_quality,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_license_scan": op5_license_scan,
    "op6_decontaminate": op6_decontaminate,
    "op7_language_id": op7_language_id,
    "op8_toxicity": op8_toxicity,
    "op9_nearest": op9_nearest,
    "op10_chat_turns": op10_chat_turns,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_minhash_dedup": op12_minhash_dedup,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL = {
    "op1_mix_sources": mixing.MIX_SQL,
    "op2_line_dedup": linededup.LINES_SQL,
    "op9_nearest": NEAREST_SQL,
    "op11_prefix_trie": prefixtrie.TRIE_SQL,
    "op13_collocations": collocations.COLLOCATIONS_SQL,
}
