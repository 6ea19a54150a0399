"""Near-duplicate documents by MinHash with tensored banding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ngramjoin import _signature, _signed, in_groups, settle
from .scratch import Scratch
from .wordhash import Powers, Words, mix, shingles, slices


def tensor_recall(similarity: float, half_rows: int, halves: int) -> float:
    """Odds that two sets of this Jaccard index meet in a table: one first half and one second half must agree."""
    return (1 - (1 - similarity**half_rows) ** halves) ** 2


def _family(functions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and shifts of ``functions`` hash functions x -> x * factor + shift of 64-bit integers."""
    rng = np.random.Generator(np.random.PCG64(seed))
    draw = lambda: rng.integers(0, 1 << 64, functions, dtype=np.uint64)
    return draw() | np.uint64(1), draw()


def half_keys(sets: list[np.ndarray], half_rows: int, halves: int, seed: int = 12) -> np.ndarray:
    """Keys of every set: ``halves`` first ones, then as many second ones, each from ``half_rows`` minhashes of its own."""
    flat, first = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(u) for u in sets])[:-1]])
    factors, shifts = _family(2 * halves * half_rows, seed)
    keys = np.empty((len(sets), 2 * halves), dtype=np.uint64)
    for slot in range(2 * halves):
        key = np.full(len(sets), slot + 1, dtype=np.uint64)
        for k in range(slot * half_rows, (slot + 1) * half_rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(flat * factors[k] + shifts[k], first))
        keys[:, slot] = key
    return keys


def _sketches(size: int, half_rows: int, halves: int):
    """doc_id, number of n-grams, hash of the set; half keys where the slice has no equal set before."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig1", pa.int64()), ("halves", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in slices(batches):
            sizes, node, sets, known = [], [], [], {}
            for u in shingles(Words(batch.column("text"), powers), size):
                sig = _signature(u)[0] if len(u) else None
                sizes.append(len(u))
                node.append(sig)
                if len(u) and sig not in known:
                    known[sig] = len(sizes) - 1
                    sets.append(u)
            keys = _signed(half_keys(sets, half_rows, halves)) if sets else np.zeros((0, 2 * halves), dtype=np.int64)
            lists = np.full(batch.num_rows, None, dtype=object)
            for row, own in zip(known.values(), keys, strict=True):
                lists[row] = own
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(node, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], schema=schema)

    return run


def _groups(nodes: DataFrame, halves: int, scratch: Scratch) -> DataFrame:
    """(lead, node): nodes that meet in a table, with the node of the table that shares most keys.

    Only half keys that two nodes share can form a table with two nodes, so the others go before halves are paired.
    """
    keys = nodes.select("node", F.posexplode("halves").alias("slot", "half"))
    shared = scratch.write(in_groups(keys, "half", scratch), "shared")
    side = lambda second: F.collect_list(F.when((F.col("slot") >= halves) == F.lit(second), F.col("half")))
    own = shared.groupBy("node").agg(side(False).alias("a"), side(True).alias("b"))
    own = own.withColumn("score", F.size("a") * F.size("b")).where("score > 0")
    tables = own.select("node", "score", F.explode("a").alias("a"), "b").select("node", "score", "a", F.explode("b").alias("b"))
    tables = scratch.write(tables.select("node", "score", F.xxhash64("a", "b").alias("key")), "tables")
    leads = tables.groupBy("key").agg(F.count(F.lit(1)).alias("in"), F.max(F.struct("score", "node")).alias("lead")).where(F.col("in") > 1)
    leads = scratch.write(leads.select("key", F.col("lead.node").alias("lead")), "leads")
    met = tables.select("node", "key").join(leads.hint("merge"), "key").select("lead", "node").distinct()
    return met


def minhash_components(
    docs: DataFrame,
    size: int = 4,
    percent: int = 80,
    half_rows: int = 3,
    halves: int = 16,
    fragments: int = 1,
    tile: int = 256,
    filter_bits: int = 1 << 23,
) -> DataFrame:
    """The connected components of documents whose sets of word n-grams have a Jaccard index of percent/100 or more.

    Tensored banding: instead of ``halves``**2 tables with 2 * ``half_rows`` minhashes each, two collections of ``halves``
    keys of ``half_rows`` minhashes are computed, and every pair of a first and a second key is the key of a table (256 tables
    of 6 minhashes from 96 minhashes, where 1536 would be needed). Two sets meet if they agree in one key of each
    collection, see :func:`tensor_recall`: with the defaults, of pairs at exactly 0.8 one in 50 000 is
    missed, at 0.85 one in two million. What meets in a table is compared on full sets, with the table's leader first
    and then, where components still differ, tile by tile (:func:`~.ngramjoin.settle`), so all links that tables find are
    confirmed and none between components is lost; equal sets are one node from the start.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a document's set is its
    distinct runs of ``size`` words (the whole sequence if it has fewer words), as 64-bit hashes.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable, its own included) and kept (doc_id =
    component_id) for every row. Null and empty texts have no n-grams and stand alone. Rows that repeat a doc_id are
    separate texts; null doc_ids take part in links but give a component its id only if there is no other (then
    null, and kept is true for rows without id). doc_ids are whole numbers. An empty table gives no rows. Only doc_id and text are read.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = scratch.write(texts.mapInArrow(_sketches(size, half_rows, halves), "doc_id long, n long, sig1 long, halves array<long>"), "sketches")
    once = sketches.where("halves is not null").groupBy(F.col("sig1").alias("node")).agg(F.first("n").alias("n"), F.first("halves").alias("halves"))
    nodes = scratch.write(once, "nodes")
    met = _groups(nodes, halves, scratch)
    members = scratch.write(met.join(nodes.select("node", "n").hint("merge"), "node"), "members")
    found = settle(sketches.select("doc_id", "n", "sig1"), members, texts.select("text"), scratch, size, percent, fragments, tile, filter_bits)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
