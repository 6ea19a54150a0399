"""Phrases whose words stand together more often than their parts suggest, counted in tiles of frequency-ranked ids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ngramjoin import _bits, _filter_words, _signed
from .scratch import Scratch
from .wordhash import SPACE, Powers, Words, mix, slices

#: Words, or phrases of one length, that have an id in every task (24 bytes each, and a byte for each possible tile). The others are counted by hash.
MOST_RANKED = 1 << 17
#: Ids of a tile's side; a tile is counted by direct addressing from so many pairs on.
_SIDE = 9
_DENSE = 1 << 2 * _SIDE - 4
#: Dense tiles that are counted at once.
_TILES = 16
#: Pairs that a task collects before it counts them, distinct words before it hands them on.
_HELD = 1 << 21
_WORDS = 1 << 17
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SALTS = 64

_HARD = np.zeros(256, dtype=bool)
_HARD[[*b".,;:!?\n\x0b\x0c\r"]] = True
_SEPARATORS = SPACE | _HARD


def _uint(x: pa.Array | np.ndarray) -> np.ndarray:
    """Signed 64-bit hashes of a table as the unsigned numbers that they stand for."""
    x = x if isinstance(x, np.ndarray) else x.to_numpy(zero_copy_only=False)
    return x.view(np.uint64) ^ np.uint64(1 << 63)


def _longer(gram: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    return mix(gram * _STEP + word)


class _Text:
    """Words of a slice, hashed with their language, and which of them go on in the same piece."""

    def __init__(self, batch: pa.RecordBatch, powers: Powers, pieces: bool = True):
        self.words = Words(batch.column("text"), powers, spans=True, separators=_SEPARATORS)
        w = self.words
        self.row = np.repeat(np.arange(batch.num_rows), np.diff(w.first))
        self.hash = mix(w.hash + batch.column("lang_hash").to_numpy(zero_copy_only=False).view(np.uint64)[self.row])
        if pieces:
            low = int(w.off[0])
            hard = np.flatnonzero(_HARD[w.raw[low : int(w.off[-1])]]) + low
            end = w.end if len(self.row) else np.zeros(0, dtype=np.int64)
            self.goes_on = (self.row[1:] == self.row[:-1]) & (np.searchsorted(hard, end[:-1]) == np.searchsorted(hard, w.start[1:]))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, lang, word, n): words of each language, summed within the task as far as they are held."""
    schema = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
    held: dict[int, list] = {}
    size = 0

    def out() -> pa.RecordBatch:
        lang, word, n = zip(*held.values(), strict=True)
        return pa.record_batch([pa.array(_signed(np.fromiter(held, dtype=np.uint64, count=len(held)))), pa.array(lang, pa.string()), pa.array([w.decode() for w in word], pa.string()), pa.array(n, pa.int64())], schema=schema)

    powers = Powers()
    for batch in slices(batches):
        text = _Text(batch, powers, pieces=False)
        langs = batch.column("lang").to_pylist()
        found, at, n = np.unique(text.hash, return_index=True, return_counts=True)
        for h, i, more in zip(found.tolist(), at.tolist(), n.tolist(), strict=True):
            known = held.get(h)
            if known:
                known[2] += more
            else:
                held[h] = [langs[text.row[i]], text.words.text(i), more]
                size += len(held[h][1]) + 64
        if len(held) >= _WORDS or size >= 1 << 25:
            yield out()
            held, size = {}, 0
    if held:
        yield out()


@dataclass
class Ranked:
    """The frequent words or phrases of one length. Those with an id by hash and by id, the others as bits that also let some rare ones pass."""

    hashes: np.ndarray
    ids: np.ndarray
    by_id: np.ndarray
    filter: np.ndarray | None

    RARE = -2
    UNRANKED = -1

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Ids; UNRANKED where a hash may be frequent without an id, RARE where it can't be."""
        out = np.full(len(h), self.RARE, dtype=np.int64)
        if self.filter is not None:
            x, y = _bits(h, len(self.filter) * 64)
            both = (self.filter[x >> 6] >> (x & 63).astype(np.uint64)) & (self.filter[y >> 6] >> (y & 63).astype(np.uint64))
            out[(both & np.uint64(1)).astype(bool)] = self.UNRANKED
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            out[hit] = self.ids[at[hit]]
        return out


def rank(counts: DataFrame, most: int) -> Ranked:
    """Ids by language and falling frequency for at most ``most`` rows of (h, lang_hash, n), taken by classes of frequency from the top; bits for the rest."""
    level = F.floor(F.log2("n") * 16).cast("int")
    classes = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect()
    least, room = 1 << 30, most
    for r in sorted(classes, key=lambda r: -r["level"]):
        if r["rows"] > room:
            break
        least, room = r["level"], room - r["rows"]
    top = counts.where(level >= least).select("h", "lang_hash", "n").toPandas()
    h = _uint(top["h"].to_numpy(dtype=np.int64))
    h = h[np.lexsort((h, -top["n"].to_numpy(dtype=np.int64), top["lang_hash"].to_numpy(dtype=np.int64)))]
    order = np.argsort(h)
    rest = sum(r["rows"] for r in classes) - len(h)
    bits = None
    if rest:
        size = min(1 << 26, max(1 << 16, 1 << int(rest * 8).bit_length()))
        found = counts.where(level < least).select((F.col("h").bitwiseXOR(F.lit(-(1 << 63)))).alias("node")).mapInArrow(_filter_words(size), "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
        bits = np.zeros(size // 64, dtype=np.uint64)
        bits[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return Ranked(h[order], order.astype(np.int64), h, bits)


def tile_counts(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of ids and their counts.

    The plane of ids is cut into square tiles. Tiles with many pairs, those of frequent ids, are counted by direct addressing, one
    bincount over a block of tiles; the pairs of all other tiles are sorted.
    """
    side, cells = (1 << _SIDE) - 1, 2 * _SIDE
    across = int(right.max(initial=0)) // (1 << _SIDE) + 1
    tile = (left >> _SIDE) * across + (right >> _SIDE)
    cell = (left & side) << _SIDE | (right & side)
    dense = np.flatnonzero(np.bincount(tile) >= _DENSE)
    code, n = [], []
    if len(dense):
        number = np.full(int(tile.max()) + 1, -1, dtype=np.int32)
        number[dense] = np.arange(len(dense))
        mine = number[tile]
        for k in range(0, len(dense), _TILES):
            here = (mine >= k) & (mine < k + _TILES)
            table = np.bincount((mine[here] - k) << cells | cell[here], minlength=min(_TILES, len(dense) - k) << cells)
            full = np.flatnonzero(table)
            code.append(dense[k + (full >> cells)] << cells | full & ((1 << cells) - 1))
            n.append(table[full])
        tile, cell = tile[mine < 0], cell[mine < 0]
    sparse, counts = np.unique(tile.astype(np.int64) << cells | cell, return_counts=True)
    code, n = np.concatenate([*code, sparse]), np.concatenate([*n, counts])
    tile = code >> cells
    return tile // across << _SIDE | code >> _SIDE & side, tile % across << _SIDE | code & side, n


def _count_phrases(length: int, words: Ranked, shorter: Ranked):
    """(first, last, n): phrases of ``length`` words as the hashes of all words but the last and of the last one.

    Only phrases whose first and last ``length`` - 1 words may be frequent are counted.
    """
    schema = pa.schema([("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64())])

    def rows(first: np.ndarray, last: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(n), 1 << 16):
            part = slice(k, k + (1 << 16))
            yield pa.record_batch([pa.array(_signed(first[part])), pa.array(_signed(last[part])), pa.array(n[part].astype(np.int64))], schema=schema)

    def ranked_rows(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        left, right, n = tile_counts(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
        yield from rows(shorter.by_id[left], words.by_id[right], n)

    def other_rows(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        first, last = (np.concatenate(x) for x in zip(*pairs, strict=True))
        _, at, n = np.unique(_longer(first, last), return_index=True, return_counts=True)
        yield from rows(first[at], last[at], n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        ranked, others, held = [], [], [0, 0]
        for batch in slices(batches):
            text = _Text(batch, powers)
            m = len(text.hash) - length + 1
            if m < 1:
                continue
            gram, inside = text.hash, np.ones(len(text.hash), dtype=bool)
            for k in range(1, length - 1):
                gram = _longer(gram[:-1], text.hash[k:])
                inside = inside[:-1] & text.goes_on[k - 1 :]
            known = shorter.look_up(gram)
            word = known if length == 2 else words.look_up(text.hash)
            joins = text.goes_on[length - 2 :]
            whole = inside[:m] & joins & (known[:m] != Ranked.RARE) & (known[1:] != Ranked.RARE) & (word[length - 1 :] != Ranked.RARE)
            at = np.flatnonzero(whole)
            left, right = known[at], word[at + length - 1]
            both = (left >= 0) & (right >= 0)
            ranked.append((left[both].astype(np.int32), right[both].astype(np.int32)))
            others.append((gram[at[~both]], text.hash[at[~both] + length - 1]))
            held = [held[0] + len(ranked[-1][0]), held[1] + len(others[-1][0])]
            if held[0] >= _HELD:
                yield from ranked_rows(ranked)
                ranked, held[0] = [], 0
            if held[1] >= _HELD:
                yield from other_rows(others)
                others, held[1] = [], 0
        if held[0]:
            yield from ranked_rows(ranked)
        if held[1]:
            yield from other_rows(others)

    return run


def _add_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = _longer(_uint(b.column("first")), _uint(b.column("last")))
        yield pa.RecordBatch.from_arrays([pa.array(_signed(h)), *b.columns], names=["h", *b.schema.names])


def _part_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all runs of words of each phrase: (h, parts), parts holding start, number of words and hash."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("h", pa.int64())]))
    for b in batches:
        out = []
        for words in b.column("words").to_pylist():
            w = _uint(np.array(words, dtype=np.int64))
            parts = []
            for start in range(len(w)):
                h = w[start : start + 1]
                for size in range(1, len(w) - start + 1):
                    if size > 1:
                        h = _longer(h, w[start + size - 1 : start + size])
                    if size < len(w):
                        parts.append({"start": start, "size": size, "h": int(_signed(h)[0])})
            out.append(parts)
        yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(out, kind)], names=["h", "parts"])


def collocations(docs: DataFrame, longest: int = 3, min_count: int = 10, percent: int = 50, top: int = 2000, most_ranked: int = MOST_RANKED) -> DataFrame:
    """The phrases of 2 to ``longest`` words that score best in each language.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at blanks and tabs. A phrase is a
    candidate if it occurs ``min_count`` times within pieces of its language, overlaps included. Cut in two, it scores
    floor(1000000 a a / (l r)), with the counts a of the phrase, l of its first and r of its second part; its lowest cut counts (of
    equal ones that after fewest words). Candidates inside a longer one that has ``percent``/100 of their occurrences are
    dropped. Arithmetic is in decimals of 38 digits, exact for counts of up to 15 digits.

    1. Words are counted per language; those with ``min_count`` occurrences get ids in the order of frequency, at most
       ``most_ranked`` of all languages (the bound of what tasks hold; the others are told from rare words by a bit
       filter of at most 8 MB).
    2. Every task counts pairs of neighbouring ids in tiles, see :func:`tile_counts`, pairs without ids by sorted hashes. Its
       counts are rows that Spark sums per pair.
    3. Frequent pairs are ranked in turn and counted with the word that follows, and so on to ``longest``. A phrase is counted only if it
       may hold two frequent phrases that are a word shorter, which loses none.

    Nothing is dropped by size: what has no id is counted by hash. Words and phrases are told apart by 64-bit hashes.
    Returns lang (null: ``und``), rank, phrase (words joined by blanks), a, l, r, n (words of the language) and score, the first
    ``top`` of each language by falling score, falling a and rising phrase (bytes). Null and empty texts have no
    words; repeated rows count each time. An empty table gives no rows. Only text and lang are read.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    texts = docs.where(F.col("text").isNotNull()).select(lang.alias("lang"), F.xxhash64(lang).alias("lang_hash"), F.col("text").cast("string").alias("text"))
    short = texts.select("lang_hash", "text")
    counted = texts.mapInArrow(_count_words, "h long, lang string, word string, n long").groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))
    every_word = scratch.write(counted, "words")
    totals = scratch.write(every_word.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    words = scratch.write(every_word.where(F.col("n") >= min_count), "frequent")
    scratch.drop(every_word)
    by_word = rank(words.withColumn("lang_hash", F.xxhash64("lang")), most_ranked)
    shorter, known = by_word, words.select("h", "lang", F.col("word").alias("phrase"), F.array("h").alias("words"), "n")
    levels = [known]
    for length in range(2, longest + 1):
        found = short.mapInArrow(_count_phrases(length, by_word, shorter), "first long, last long, n long")
        found = found.groupBy("first", "last").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
        grams = scratch.write(found.mapInArrow(_add_hash, "h long, first long, last long, n long"), f"phrases{length}")
        head = known.select(F.col("h").alias("first"), "lang", "phrase", "words")
        tail = words.select(F.col("h").alias("last"), "word")
        named = grams.join(head.hint("merge"), "first").join(tail.hint("merge"), "last")
        named = named.select("h", "lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), F.concat("words", F.array("last")).alias("words"), "n")
        known = scratch.write(named, f"named{length}")
        levels.append(known)
        if length < longest:
            shorter = rank(known.withColumn("lang_hash", F.xxhash64("lang")), most_ranked)
    return _scored(levels, totals, scratch, percent, top)


def _scored(levels: list[DataFrame], totals: DataFrame, scratch: Scratch, percent: int, top: int) -> DataFrame:
    phrases = levels[1]
    for more in levels[2:]:
        phrases = phrases.unionByName(more)
    counts = levels[0].select("h", "n").unionByName(phrases.select("h", "n"))
    parts = scratch.write(phrases.select("h", "words").mapInArrow(_part_hashes, "h long, parts array<struct<start:int,size:int,h:long>>"), "parts")
    sizes = phrases.select("h", "n", F.size("words").alias("size"))
    part = parts.select(F.col("h").alias("whole"), F.explode("parts").alias("part")).select("whole", "part.*")
    part = scratch.write(part.join(counts.hint("merge"), "h").withColumnRenamed("n", "count"), "counted")
    inside = part.where("size > 1").join(sizes.select(F.col("h").alias("whole"), F.col("n").alias("longer")).hint("merge"), "whole")
    inside = inside.groupBy("h").agg(F.max("longer").alias("longer"))
    front = part.where("start = 0").select("whole", F.col("size").alias("k"), F.col("count").alias("l"))
    back = part.where("start > 0").select("whole", F.col("start").alias("k"), "size", F.col("count").alias("r"))
    cut = front.join(back.hint("merge"), ["whole", "k"]).join(sizes.withColumnRenamed("size", "all").withColumnRenamed("h", "whole").hint("merge"), "whole").where(F.col("k") + F.col("size") == F.col("all"))
    cut = cut.withColumn("score", F.expr("cast(1000000 as decimal(7,0)) * cast(n as decimal(15,0)) * cast(n as decimal(15,0)) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"))
    lowest = cut.groupBy("whole").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select(F.col("whole").alias("h"), "cut")
    kept = phrases.join(lowest.hint("merge"), "h").join(inside.hint("merge"), "h", "left").where(F.coalesce(100 * F.col("longer") < percent * F.col("n"), F.lit(True)))
    rows = scratch.write(kept.select("lang", "phrase", F.col("n").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")), "candidates")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))).orderBy(*order)
    first = rows.withColumn("place", F.row_number().over(salted)).where(F.col("place") <= top).drop("place")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


COLLOCATIONS_SQL = """
WITH pieces AS (
  SELECT lang, row, generate_subscripts(parts, 1) AS piece, unnest(parts) AS text
  FROM (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS row,
               regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS parts
        FROM documents)),
words AS (
  SELECT lang, row, piece, generate_subscripts(list, 1) AS place, unnest(list) AS w
  FROM (SELECT lang, row, piece, list_filter(regexp_split_to_array(text, '[\\x20\\x09]+'), lambda w: w <> '') AS list FROM pieces)),
runs AS (SELECT lang, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY row, piece ORDER BY place)),
one AS (SELECT lang, w, count(*) AS f FROM runs GROUP BY ALL),
two AS (SELECT lang, w, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, w, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang),
cuts AS (
  SELECT t.lang, t.w || ' ' || t.w2 AS phrase, t.f AS a, 1 AS k, x.f AS l, y.f AS r,
         coalesce((SELECT max(z.f) FROM three z WHERE z.lang = t.lang AND ((z.w = t.w AND z.w2 = t.w2) OR (z.w2 = t.w AND z.w3 = t.w2))), 0) AS longer
  FROM two t JOIN one x ON x.lang = t.lang AND x.w = t.w JOIN one y ON y.lang = t.lang AND y.w = t.w2
  UNION ALL
  SELECT t.lang, t.w || ' ' || t.w2 || ' ' || t.w3, t.f, 1, x.f, y.f, 0
  FROM three t JOIN one x ON x.lang = t.lang AND x.w = t.w JOIN two y ON y.lang = t.lang AND y.w = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f, 0
  FROM three t JOIN two x ON x.lang = t.lang AND x.w = t.w AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.w = t.w3),
scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest WHERE 100 * longer < 50 * a)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN total t ON r.lang = t.lang WHERE r.rank <= 2000
"""
