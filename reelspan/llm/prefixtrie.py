"""Prefix trie of conversations by truncation peeling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: The longest conversations, so many of them and so many turns at most, are peeled beside the levels, a group of one opening in one task.
DEEP_CONVERSATIONS = 1 << 10
DEEP_TURNS = 1 << 17
#: Conversations are stored in folders by their length, all longer ones in the last.
_FOLDERS = 64
#: 2 to this power neighbouring ids are listed in one row before they are hashed.
_ID_BITS = 12

_TURN = "depth int, k1 long, k2 long, len long, t1 long, t2 long"
_NODE = f"conv_id long, depth int, k1 long, k2 long, p1 long, p2 long, t1 long, t2 long, n_convs long, n_children long, n_leaves long, saved_tokens long, path array<struct<{_TURN.replace(' ', ':').replace(',:', ',')}>>"
_COLUMNS = [c.strip().split(" ")[0] for c in _NODE.split(", path")[0].split(",")] + ["path"]


def _turn_hashes() -> list[Column]:
    return [F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit("#"), "text", "role").alias("t2")]


def _filled(conversations: DataFrame, *columns: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), *columns, text("role"), text("text"))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at from 1, hashes of role and text, code points of the text): turns by ``turn``, null first, ties by role and text.

    Null roles and texts are empty. Rows without conv_id belong to no conversation and are left out.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = _filled(conversations, "turn").withColumn("at", F.row_number().over(order))
    return rows.select("conv_id", "at", *_turn_hashes(), F.char_length("text").cast("long").alias("len"))


def shared_openings(turns: DataFrame, every: int = 100, shares: int = 6) -> DataFrame:
    """Rebuild each conversation c: the first h turns of conversation c - c % ``every``, then its own after its first h; h is crc32(c) % ``shares``.

    Takes and returns rows as of :func:`ordered_turns`. If the other conversation has fewer turns, all of them
    are taken, none if there is no such conversation. A conversation may end up without turns.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % shares
    own = turns.where(F.col("at") > h).withColumn("part", F.lit(1))
    asked = turns.where("at = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h")).where("h > 0")
    heads = turns.where(F.col("at") < shares).withColumnRenamed("conv_id", "base")
    taken = asked.join(heads.hint("merge"), "base").where("at <= h").withColumn("part", F.lit(0))
    both = own.unionByName(taken.select(*own.columns))
    return both.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "at"))).drop("part")


def _paths(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, path, n): every conversation's turns in order, with two hashes of what precedes and includes each."""
    so_far = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    keys = [F.bit_xor(F.xxhash64(*tag, "t1", "t2", "at")).over(so_far).alias(k) for k, tag in (("k1", []), ("k2", [F.lit("#")]))]
    keyed = turns.select("conv_id", F.struct(F.col("at").cast("int").alias("depth"), *keys, F.col("len"), F.col("t1"), F.col("t2")).alias("turn"))
    paths = keyed.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("path"))
    empty = F.expr(f"cast(array() as {_NODE.split('path ')[1]})")
    known = ids.join(paths.hint("merge"), "conv_id", "left").withColumn("path", F.coalesce("path", empty))
    return known.select("conv_id", "path", F.size("path").alias("n"), F.least(F.size("path"), F.lit(_FOLDERS)).alias("folder"))


def _last(field: str, back: int = 1) -> Column:
    """A field of the last turn of ``path`` (or of one before); 0 where there is none."""
    return F.coalesce(F.get("path", F.size("path") - back)[field], F.lit(0).cast("long"))


def _level(rows: DataFrame, depth: int) -> DataFrame:
    """Nodes of one depth: conversations that end there merge with what deeper nodes have become by losing their last turn."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    met = rows.groupBy("path").agg(F.min("conv_id").alias("conv_id"), *sums)
    return met.select(
        "conv_id",
        F.lit(depth).alias("depth"),
        _last("k1").alias("k1"),
        _last("k2").alias("k2"),
        _last("k1", 2).alias("p1"),
        _last("k2", 2).alias("p2"),
        _last("t1").alias("t1"),
        _last("t2").alias("t2"),
        "n_convs",
        "n_children",
        F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * _last("len")).alias("saved_tokens"),
        "path",
    )


def _peel_deep(least: int):
    """Nodes below depth ``least`` of whole groups of conversations; those of depth ``least`` + 1 keep their path and go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ended: dict[int, list[tuple[int, list]]] = {}
        for batch in batches:
            for conv, path in zip(batch["conv_id"], batch["path"], strict=True):
                ended.setdefault(len(path), []).append((conv, path))
        alive: dict[tuple[int, int], list] = {}
        for depth in range(max(ended, default=0), least, -1):
            for conv, path in ended.pop(depth, []):
                node = alive.setdefault((path[depth - 1]["k1"], path[depth - 1]["k2"]), [conv, path, 0, 0, 0, 0])
                node[0] = min(node[0], conv)
                node[2] += 1
            rows, above = [], {}
            for conv, path, n, children, leaves, saved in alive.values():
                turn, parent = path[depth - 1], path[depth - 2] if depth > 1 else {"k1": 0, "k2": 0}
                leaves, saved = leaves if children else 1, saved + (n - 1) * turn["len"]
                kept = list(path[:depth]) if depth == least + 1 else None
                rows.append((conv, depth, turn["k1"], turn["k2"], parent["k1"], parent["k2"], turn["t1"], turn["t2"], n, children, leaves, saved, kept))
                up = above.setdefault((parent["k1"], parent["k2"]), [conv, path, 0, 0, 0, 0])
                up[0] = min(up[0], conv)
                for k, more in enumerate((n, 1, leaves, saved), 2):
                    up[k] += more
            alive = above
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return run


def _hash_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the id lists of each node, whose rows follow one another; nothing but the hash's state is held."""
    now, state = None, None

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([state.hexdigest()])], names=["k1", "k2", "ends_sha256"])

    for batch in batches:
        done: list[pa.RecordBatch] = []
        for k1, k2, ids in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if (k1, k2) != now:
                if state:
                    done.append(row())
                now, state = (k1, k2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if state:
        yield row()


def _ends(paths: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of every node at which conversations end."""
    listed = paths.groupBy(_last("k1").alias("k1"), _last("k2").alias("k2"), F.shiftright("conv_id", _ID_BITS).alias("part"))
    listed = listed.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))
    ordered = listed.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "part").select("k1", "k2", "ids")
    return ordered.mapInArrow(_hash_of_ids, "k1 long, k2 long, ends_sha256 string")


def _deep_from(paths: DataFrame, most_convs: int, most_turns: int) -> tuple[int, int]:
    """(depth below which at most so many conversations with so many turns reach, the maximum depth)."""
    lengths = paths.groupBy("n").agg(F.count(F.lit(1)).alias("convs")).collect()
    convs = turns = 0
    deepest = max((r["n"] for r in lengths), default=0)
    for r in sorted(lengths, key=lambda r: -r["n"]):
        convs, turns = convs + r["convs"], turns + r["convs"] * r["n"]
        if convs > most_convs or turns > most_turns:
            return r["n"], deepest
    return 0, deepest


def prefix_trie(turns: DataFrame, ids: DataFrame, deep_conversations: int = DEEP_CONVERSATIONS, deep_turns: int = DEEP_TURNS) -> DataFrame:
    """The trie of all openings of conversations, by peeling from the longest.

    ``turns`` are rows as of :func:`ordered_turns`, ``ids`` (conv_id) all conversations, those without turns too.
    Level by level from the greatest depth, conversations that end at a depth meet the nodes that have survived from
    below, are grouped by all their turns, and each group is a node; it then loses its last turn and goes up with
    its sums of members, leaves and saved code points. So nodes are found and aggregated in one pass, and each
    level is one aggregate with partial sums before the shuffle, written to the shared folder. The few longest
    conversations (``deep_conversations`` and ``deep_turns`` at most, by count) are peeled down to where the others
    begin inside tasks, grouped by their opening.

    Returns per node conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 (of the ids of members that end there; ascending, comma-joined) and the hashes t1, t2 of its last turn
    (root: 0), for :func:`with_texts`. Openings are told apart by 128 bits. A conversation is held as one row of 44 bytes a turn. An
    empty table gives no rows: without conversations there is no root. Ids that repeat in ``ids`` count once.
    """
    spark: SparkSession = turns.sparkSession
    scratch = Scratch(spark, "trie")
    paths = scratch.write(_paths(turns, ids.select("conv_id").where("conv_id is not null").distinct()), "paths", by="folder")
    least, deepest = _deep_from(paths, deep_conversations, deep_turns)
    levels: list[DataFrame] = []
    if deepest > least:
        opening = F.get("path", F.lit(least))["k1"]
        deep = paths.where((F.col("folder") >= min(least + 1, _FOLDERS)) & (F.col("n") > least)).select("conv_id", "path")
        levels.append(scratch.write(deep.repartition(opening).mapInPandas(_peel_deep(least), _NODE), "deep"))
    if deepest >= 0 and not paths.isEmpty():
        for depth in range(min(least, deepest), -1, -1):
            ended = paths.where((F.col("folder") == min(depth, _FOLDERS)) & (F.col("n") == depth))
            rows = ended.select("path", "conv_id", F.lit(1).cast("long").alias("n_convs"), *[F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
            if levels:
                below = levels[-1].where(F.col("depth") == depth + 1)
                stripped = F.slice("path", 1, depth) if depth else F.slice("path", 1, 0)
                rows = rows.unionByName(below.select(stripped.alias("path"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens"))
            levels.append(scratch.write(_level(rows, depth), f"depth{depth}"))
    if not levels:
        return paths.select(*[F.lit(None).cast(kind).alias(name) for name, kind in (("conv_id", "long"), ("depth", "long"), ("parent_conv_id", "long"), ("n_convs", "long"), ("n_children", "long"), ("n_leaves", "long"), ("saved_tokens", "long"), ("ends_sha256", "string"), ("t1", "long"), ("t2", "long"))])
    nodes = spark.read.schema(levels[-1].schema).parquet(*[t._scratch_path for t in levels]).drop("path")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    ends = scratch.write(_ends(paths), "ends")
    named = nodes.join(parents.hint("merge"), ["depth", "p1", "p2"], "left").join(ends.hint("merge"), ["k1", "k2"], "left")
    return named.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
        "t1",
        "t2",
    )


def with_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes with role and text of their last turn (root: null)."""
    texts = _filled(conversations).select(*_turn_hashes(), "role", "text").groupBy("t1", "t2").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    return nodes.join(texts.hint("merge"), ["t1", "t2"], "left")


#: crc32 bit by bit; every opening is a row, leaves and savings are added to all openings above them.
TRIE_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT]))),
           lambda x, b: xor(xor(x, b) >> 1, 3988292384::UBIGINT * (xor(x, b) & 1::UBIGINT))), 4294967295::UBIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth FROM rebuilt),
openings AS (
  SELECT conv_id, depth, len, list_reduce(list_prepend('', turns), lambda x, t: sha256(x || t)) AS key
  FROM (SELECT conv_id, depth, length(text) AS len,
               list(length(role)::VARCHAR || ':' || role || text) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS turns
        FROM placed)
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs),
linked AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, lead(key) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM openings),
nodes AS (
  SELECT key, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(parent) AS parent, count(*) AS n_convs, any_value(len) AS len,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM linked GROUP BY key),
grown AS (
  SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.parent = n.key) AS n_children FROM nodes n),
above AS (
  SELECT o.key, g.n_children, g.n_convs, g.len
  FROM grown g JOIN openings o ON o.conv_id = g.conv_id AND o.depth <= g.depth),
sums AS (
  SELECT key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * len) AS BIGINT) AS saved_tokens FROM above GROUP BY key)
SELECT g.conv_id, g.depth, p.conv_id AS parent_conv_id, g.n_convs, g.n_children, s.n_leaves, s.saved_tokens, g.ends_sha256
FROM grown g JOIN sums s ON g.key = s.key LEFT JOIN nodes p ON g.parent = p.key
"""
