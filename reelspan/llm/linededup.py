"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import numbered, with_row
from .scratch import Scratch
from .wordhash import slices

#: White space that is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys that are held by every task at most (16 bytes each); with more, lines are joined instead.
MOST_BROADCAST = 1 << 20


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hashes(key: Column) -> Column:
    """128 bits of a line key."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.concat(F.lit("#"), key)).alias("h2"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys_of(text: Column, min_chars: int) -> Column:
    """Distinct hashes of the keys of a text's lines."""
    keys = F.filter(F.transform(_lines(text), line_key), lambda k: F.char_length(k) >= min_chars)
    return F.transform(F.array_distinct(keys), _hashes)


def _holder(doc_id: Column, text: Column) -> Column:
    """A number that orders rows by doc_id (null last), rows of one id by 18 digits of the text's hash."""
    number = F.coalesce(doc_id.cast("decimal(20,0)"), F.lit("1" + "0" * 19).cast("decimal(20,0)"))
    return (number * F.lit(10**18).cast("decimal(19,0)") + F.pmod(F.xxhash64(text), F.lit(10**18)).cast("decimal(18,0)")).cast("decimal(38,0)")


def _same_key(keys: DataFrame, others: DataFrame, how: str) -> DataFrame:
    return keys.join(others.select("h1", "h2").hint("merge"), ["h1", "h2"], how)


class LineRuns:
    """Levelled runs of (h1, h2, n): key hashes, sorted inside each file, and the number of documents that hold the key.

    With ``holders`` there is also the smallest holder of each key.

    A batch of lines first loses, in its scan, the settled keys, those already found in ``enough`` documents, so that
    they reach no aggregate (``add_lines``); its counts merge-anti-join the settled run. What is left becomes a run of its own on level 0. When a level has ``fanout`` runs they are
    compacted into one on the next level, counts added; keys that reach ``enough`` there move to the
    settled run. So a table of B batches has O(log B) runs, and no run holds a key that is known to be frequent.
    Batches come in the order of their holders, so a settled key has met its smallest one.
    """

    def __init__(self, scratch: Scratch, enough: int = 10, fanout: int = 2, holders: bool = False, most_held: int = MOST_BROADCAST):
        self.scratch, self.enough, self.fanout, self.most_held = scratch, enough, fanout, most_held
        self.levels: list[list[DataFrame]] = []
        self.settled: list[DataFrame] = []
        self.extra = ["holder"] if holders else []

    def runs(self) -> list[DataFrame]:
        return [*self.settled, *(r for level in self.levels for r in level)]

    def fresh(self, keys: DataFrame) -> DataFrame:
        """Rows of ``keys`` (h1, h2, ...) whose key no run has."""
        for r in self.runs():
            keys = _same_key(keys, r, "left_anti")
        return keys

    def _summed(self, runs: list[DataFrame]) -> DataFrame:
        both = runs[0]
        for r in runs[1:]:
            both = both.unionByName(r)
        return both.groupBy("h1", "h2").agg(F.sum("n").alias("n"), *[F.min(c).alias(c) for c in self.extra])

    def held(self) -> DataFrame | None:
        """Settled keys that every task may hold, ``most_held`` at most (counted): all of them, or the most frequent by powers of two.

        Batches have one size, so a key that is left out has less than two in ``most_held`` of a batch's lines.
        """
        if not self.settled:
            return None
        settled = self._summed(self.settled).withColumn("power", F.floor(F.log2("n")))
        least, total = None, 0
        for r in sorted(settled.groupBy("power").count().collect(), reverse=True):
            total += r["count"]
            if total > self.most_held:
                break
            least = r["power"]
        return None if least is None else settled.where(F.col("power") >= least).select("h1", "h2")

    def add_lines(self, keys: DataFrame, compact: bool = True) -> None:
        """Add a batch of (h1, h2), a row for each document and key.

        Settled keys go before anything is shuffled or counted; with more than ``most_held`` of them the rarer ones
        are summed by the scan's tasks and go in the merge-anti-join of ``add``. A key that is frequent in
        this batch alone is summed before it is shuffled, too.
        """
        held = self.held()
        if held is not None:
            keys = keys.join(F.broadcast(self.scratch.write(held, "held")), ["h1", "h2"], "left_anti")
        self.add(keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in self.extra]), compact)

    def add(self, counts: DataFrame, compact: bool = True) -> None:
        """Add a batch of (h1, h2, n), each key once. Without ``compact``, for the last batch of all, no level is merged."""
        counts = counts.select("h1", "h2", "n", *self.extra)
        for r in self.settled:
            counts = _same_key(counts, r, "left_anti")
        self._push(self.scratch.write(counts.select("h1", "h2", "n", *self.extra).sortWithinPartitions("h1", "h2"), "run"), 0, compact)

    def _push(self, run: DataFrame, level: int, compact: bool = True) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if compact and len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            # one table, in two folders: keys that have enough documents, and the rest
            both = self._summed(old).withColumn("enough", F.col("n") >= self.enough).sortWithinPartitions("enough", "h1", "h2")
            both = self.scratch.write(both, "merged", by="enough")
            settled = [*self.settled, both.where("enough").drop("enough")]
            if len(settled) > self.fanout:
                settled = [self.scratch.write(self._summed(settled).sortWithinPartitions("h1", "h2"), "settled")]
            self.settled = settled
            self.scratch.drop(*[r for r in old if hasattr(r, "_scratch_path")])
            self._push(both.where("not enough").drop("enough"), level + 1)

    def frequent(self) -> DataFrame:
        """(h1, h2) and the smallest holder of every key found in ``enough`` documents."""
        last = self._summed(self.runs()).where(F.col("n") >= self.enough) if self.runs() else None
        if last is None:
            raise ValueError("no batch was added")
        return self.scratch.write(last.select("h1", "h2", *self.extra), "frequent")


def _batches(docs: DataFrame, docs_per_batch: int, least: int) -> tuple[Column, int]:
    """Number of a document's batch, ranges of doc_id of about equal size (null ids in the last), and how many there are."""
    n = max(least, -(-docs.count() // docs_per_batch))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000).alias("cuts")).first()["cuts"] or []
    number = F.lit(0)
    for c in sorted(set(cuts)):
        number = number + (F.coalesce(F.col("doc_id") > c, F.lit(True))).cast("int")
    return number, len(set(cuts)) + 1


def drop_frequent_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, docs_per_batch: int = 1 << 28, least_batches: int = 4, most_broadcast: int = MOST_BROADCAST, keep_one: bool = False
) -> DataFrame:
    """Drop from every document all lines whose key stands in ``min_docs`` documents or more.

    With ``keep_one`` one holder of each such key, the row with the smallest doc_id, keeps its lines.

    A key is the line without ASCII white space at both ends, A-Z lower-cased; keys of fewer than
    ``min_chars`` code points are never dropped. One scan writes the lines' hashes, batch by batch: ranges of
    doc_id of about ``docs_per_batch`` documents, ``least_batches`` of them at least. The batches then go through
    :class:`LineRuns` one after the other; afterwards the frequent keys are known exactly. Where they are at most ``most_broadcast`` (counted, 24 bytes each), every task looks
    its lines up in them; beyond that the lines are joined with them and regrouped by text. Hashes have 128 bits.

    Returns ``row`` (a struct of all input columns, so names can't clash), ``kept`` (the other lines joined
    by newlines), ``n_lines`` (before) and ``n_dropped``. Null or empty text is one empty line. Every row
    is a document of its own, also where doc_ids (whole numbers) repeat or are null. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    own = {"holder": _holder(F.col("doc_id"), F.col("text"))} if keep_one else {}
    batch, batches = _batches(docs, docs_per_batch, least_batches)
    keys = docs.select(batch.alias("batch"), *[c.alias(n) for n, c in own.items()], F.explode(_keys_of(F.col("text"), min_chars)).alias("key"))
    hashed = scratch.write(keys.select("batch", "key.h1", "key.h2", *own), "hashes", by="batch")
    runs = LineRuns(scratch, min_docs, holders=keep_one)
    for b in range(batches):
        runs.add_lines(hashed.where(F.col("batch") == b).drop("batch"), compact=b < batches - 1)
    frequent = runs.frequent()
    scratch.drop(hashed)
    holder = {n: F.xxhash64(c) for n, c in own.items()}
    if frequent.count() <= most_broadcast:
        packed, text = numbered(docs, None, **holder)
        held = frequent.select("h1", "h2", *[F.xxhash64(c).alias(c) for c in own]).toPandas().sort_values(["h1", "h2"])
        arrays = [held[c].to_numpy(np.int64) for c in ("h1", "h2", *own)]
        kind = T.StructType([*[f for f in packed.schema if f.name != "holder"], T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        return with_row(packed.mapInArrow(_without(arrays, text, min_chars), kind), docs, None, "kept", "n_lines", "n_dropped")
    frequent = frequent.select("h1", "h2", *[F.xxhash64(c).alias(c) for c in own])
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", *[c.alias(n) for n, c in holder.items()])
    ident = [F.coalesce(F.xxhash64("text"), F.lit(0)).alias("t1"), F.xxhash64(F.concat(F.lit("#"), F.coalesce("text", F.lit("")))).alias("t2")]
    lines = docs.select(*ident, F.posexplode(F.transform(_lines(F.col("text")), line_key)).alias("at", "key"))
    # lines too short for a key get hashes of their own, which meet nothing
    hashes = [F.when(F.char_length("key") >= min_chars, _hashes(F.col("key"))[h]).otherwise(F.xxhash64("t1", "t2", "at")).alias(h) for h in ("h1", "h2")]
    lines = lines.select("t1", "t2", "at", *hashes).distinct()
    marked = lines.join(frequent.withColumn("found", F.lit(True)).hint("merge"), ["h1", "h2"], "left").select("t1", "t2", F.struct("at", "found", *own).alias("mark"))
    marks = marked.groupBy("t1", "t2").agg(F.array_sort(F.collect_list("mark")).alias("marks"))
    joined = packed.select("row", "text", *own, *ident).join(marks.hint("merge"), ["t1", "t2"])
    gone = lambda mark: mark["found"].isNotNull() & (mark["holder"] != F.col("holder")) if keep_one else mark["found"].isNotNull()
    # line by line its mark at the same place, so the work is linear in the lines
    kept = F.filter(_lines(F.col("text")), lambda x, at: ~gone(F.get(F.col("marks"), at)))
    return joined.select("row", F.array_join(kept, "\n").alias("kept"), F.size("marks").cast("long").alias("n_lines"), (F.size("marks") - F.size(kept)).cast("long").alias("n_dropped"))


def _without(frequent: list[np.ndarray], text_column: str, min_chars: int):
    """Texts without their frequent lines; ``frequent`` has h1 (sorted), h2 and, where one holder keeps a line, that row's hash."""
    blanks = BLANKS.encode()
    first, second, *holders = frequent

    def listed(h1: int, at: int, key: bytes, holder: int | None) -> bool:
        while at < len(first) and first[at] == h1:
            h2 = xxhash.xxh64_intdigest(b"#" + key, seed=42)
            if second[at] == h2 - (h2 >> 63 << 64):
                return holder is None or holders[0][at] != holder
            at += 1
        return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            kept, n_lines, n_dropped = [], [], []
            own = batch.column("holder").to_pylist() if holders else [None] * batch.num_rows
            for text, holder in zip(batch.column(text_column), own, strict=True):
                lines = (text.as_py() or "").encode().split(b"\n")
                keys = [x.strip(blanks).lower() for x in lines]
                h1 = np.array([xxhash.xxh64_intdigest(k, seed=42) for k in keys], dtype=np.uint64).view(np.int64)
                at = np.searchsorted(first, h1)
                maybe = np.flatnonzero(first[np.minimum(at, len(first) - 1)] == h1).tolist() if len(first) else ()
                gone = {k for k in maybe if listed(h1[k], int(at[k]), keys[k], holder) and len(keys[k].decode()) >= min_chars}
                kept.append(b"\n".join(x for k, x in enumerate(lines) if k not in gone).decode())
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
            names = [n for n in batch.schema.names if n != "holder"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "kept", "n_lines", "n_dropped"])

    return run


def dedup_batch(docs: DataFrame, runs: LineRuns, min_chars: int = 1) -> DataFrame:
    """Keep-first dedup of one batch against earlier ones: lines whose key is in ``runs`` are dropped, then the batch's keys are added.

    Returns doc_id and kept. Inside a batch every document keeps its lines. Null or empty text is one
    empty line; rows that repeat a doc_id and text count once.
    """
    lines = docs.select("doc_id", "text").distinct().select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    keyed = runs.scratch.write(lines.withColumn("key", line_key(F.col("line"))).select("*", F.xxhash64("key").alias("h1"), F.xxhash64(F.concat(F.lit("#"), "key")).alias("h2")), "lines")
    short = keyed.where(F.char_length("key") < min_chars)
    left = runs.fresh(keyed.where(F.char_length("key") >= min_chars)).select(*keyed.columns).unionByName(short)
    kept = left.groupBy("doc_id", "t").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("x"))
    out = docs.select("doc_id", F.xxhash64("text").alias("t")).distinct().alias("d").join(kept.alias("k").hint("merge"), F.expr("d.doc_id <=> k.doc_id and d.t = k.t"), "left")
    out = runs.scratch.write(out.select("d.doc_id", F.coalesce(F.array_join(F.transform("k.x", lambda s: s["line"]), "\n"), F.lit("")).alias("kept")), "kept")
    runs.add(keyed.where(F.char_length("key") >= min_chars).groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n")))
    return out


#: Every row is a document of its own, also where doc_ids repeat.
LINES_SQL = """
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
lines AS (
  SELECT doc_id, row, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM rows),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10),
marked AS (SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row, doc_id
"""
