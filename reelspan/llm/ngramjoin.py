"""N-gram Jaccard join by vertical partitioning: partial overlaps per fragment of the global n-gram order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch
from .wordhash import Powers, Words, mix, shingles, slices

#: N-grams that come last in the global order; a bound on what is broadcast, not on what is joined.
MOST_FREQUENT = 1 << 16
#: An n-gram is counted as frequent where it has this many different documents in a run of _RUN n-grams.
_LOCAL = 8
_RUN = 1 << 22


def _common(n: int) -> int:
    """N-grams by which a prefix is longer than needed for one in common: so many are then in common."""
    return 1 + n // 10


def _signed(x: np.ndarray) -> np.ndarray:
    """The same order in signed integers."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def _unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64) ^ np.uint64(1 << 63)


def _signature(u: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set of n-grams."""
    return int(_signed(np.array([mix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)]))[0]), int(_signed(np.array([mix(u + np.uint64(0x1234567)).sum(dtype=np.uint64)]))[0])


def _signatures(size: int):
    """kind 0: doc_id, number of n-grams, signature. kind 1: a locally frequent n-gram and its count."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sig1", pa.int64()), ("sig2", pa.int64())])

    def frequent(sets: list[np.ndarray]) -> pa.RecordBatch:
        grams, counts = np.unique(np.concatenate(sets), return_counts=True)
        grams, counts = grams[counts >= _LOCAL], counts[counts >= _LOCAL].astype(np.int64)
        nothing = pa.nulls(len(grams), pa.int64())
        return pa.record_batch([pa.array(np.ones(len(grams), dtype=np.int32)), nothing, pa.array(counts), pa.array(_signed(grams)), nothing], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, known, sets, held = Powers(), set(), [], 0
        for batch in slices(batches):
            sizes, one, two = [], [], []
            for u in shingles(Words(batch.column("text"), powers), size):
                a, b = _signature(u) if len(u) else (None, None)
                sizes.append(len(u))
                one.append(a)
                two.append(b)
                if len(u) and a not in known:
                    known.add(a)
                    sets.append(u)
                    held += len(u)
                if held >= _RUN:
                    yield frequent(sets)
                    known, sets, held = set(), [], 0
            yield pa.record_batch([pa.array(np.zeros(len(sizes), dtype=np.int32)), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], schema=schema)
        if sets:
            yield frequent(sets)

    return run


def _prefixes(size: int, percent: int, frequent: pa.Array):
    """Per document its signature and the prefix of its n-grams in the global order."""
    schema = pa.schema([("sig1", pa.int64()), ("sig2", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        grams, ranks = frequent
        for batch in slices(batches):
            one, two, prefixes = [], [], []
            known = set()
            for u in shingles(Words(batch.column("text"), powers), size):
                if not len(u):
                    continue
                a, b = _signature(u)
                if a in known:
                    continue
                known.add(a)
                at = np.minimum(np.searchsorted(grams, u), max(0, len(grams) - 1))
                last = grams[at] == u if len(grams) else np.zeros(len(u), dtype=bool)
                rare, often = u[~last], u[last]
                if len(often):
                    often = often[np.argsort(ranks[at[last]], kind="stable")]
                keep = len(u) - -(-percent * len(u) // 100) + _common(len(u))
                one.append(a)
                two.append(b)
                prefixes.append(_signed(np.concatenate([rare, often])[:keep]))
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            yield pa.record_batch([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], schema=schema)

    return run


def _bits(nodes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = nodes.view(np.uint64)
    return (h % np.uint64(bits)).astype(np.int64), (mix(h) % np.uint64(bits)).astype(np.int64)


def _fragments(size: int, fragments: int, filter_words: np.ndarray):
    """The n-grams of documents whose node may be wanted, cut into fragments of the hash order."""
    schema = pa.schema([("node", pa.int64()), ("fragment", pa.int32()), ("grams", pa.list_(pa.int64()))])
    bits = len(filter_words) * 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        cuts = np.array([(k << 64) // fragments for k in range(1, fragments)], dtype=np.uint64)
        for batch in slices(batches):
            sets, nodes, known = [], [], set()
            for u in shingles(Words(batch.column("text"), powers), size):
                node = _signature(u)[0] if len(u) else None
                if node is not None and node not in known:
                    known.add(node)
                    sets.append(u)
                    nodes.append(node)
            rows: list[list] = [[], [], []]
            if sets:
                x, y = _bits(np.array(nodes, dtype=np.int64), bits)
                wanted = ((filter_words[x >> 6] >> (x & 63).astype(np.uint64)) & (filter_words[y >> 6] >> (y & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
                for k in np.flatnonzero(wanted):
                    u = sets[k]
                    edges = [0, *np.searchsorted(u, cuts).tolist(), len(u)]
                    for f in range(fragments):
                        rows[0].append(nodes[k])
                        rows[1].append(f)
                        rows[2].append(_signed(u[edges[f] : edges[f + 1]]))
            flat = np.concatenate(rows[2]) if rows[2] else np.zeros(0, dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in rows[2]])]).astype(np.int32)
            yield pa.record_batch([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], schema=schema)

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows with equal keys, from batches in which they stand together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        head = tuple(c[0] for c in columns)
        starts = np.concatenate([[0], np.flatnonzero(change), [batch.num_rows]])
        if held and head != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(starts[:-2].tolist(), starts[1:-1].tolist(), strict=True):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(int(starts[-2]), int(starts[-1] - starts[-2])))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _lists(table: pa.Table, name: str) -> list[np.ndarray]:
    return [x for chunk in table.column(name).chunks for x in np.split(chunk.flatten().to_numpy(), np.cumsum(pc.list_value_length(chunk).to_numpy())[:-1])]


def _overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many n-grams the sets a and the sets b share, for every pair; a few thousand n-grams at once."""
    if len(sets) == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        full = np.array([[len(sets[0]), common], [common, len(sets[1])]], dtype=np.float64)
        return full[np.ix_(a, b)]
    out = np.zeros((len(a), len(b)))
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, gram, count = np.unique(grams, return_inverse=True, return_counts=True)
    shared = count[gram] > 1
    if shared.any():
        owner, (_, gram) = owner[shared], np.unique(gram[shared], return_inverse=True)
        for at in range(0, int(gram.max()) + 1, 4096):
            now = (gram >= at) & (gram < at + 4096)
            m = np.zeros((len(sets), min(4096, int(gram.max()) + 1 - at)), dtype=np.float32)
            m[owner[now], gram[now] - at] = 1
            out += m[a] @ m[b].T
    return out


def _near(percent: int):
    """Nodes of a tile that may be linked with one of another component, by one fragment: what is shared there, and at most all the rest of the smaller set."""
    schema = pa.schema([("lead", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["lead", "i", "j"]):
            node, comps, n, side = (g.column(c).to_numpy() for c in ("node", "comp", "n", "side"))
            a, b = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
            sets = _lists(g, "grams")
            rest = n - np.array([len(x) for x in sets])
            most = _overlaps(sets, a, b) + np.minimum(rest[a][:, None], rest[b][None, :])
            may = (100 * most >= percent * (n[a][:, None] + n[b][None, :] - most)) & (comps[a][:, None] != comps[b][None, :])
            nodes = node[np.union1d(a[may.any(axis=1)], b[may.any(axis=0)])]
            tile = [pa.repeat(pa.scalar(g.column(c)[0].as_py(), t), len(nodes)) for c, t in (("lead", pa.int64()), ("i", pa.int32()), ("j", pa.int32()))]
            yield pa.record_batch([*tile, pa.array(nodes)], schema=schema)

    return run


def _cross_links(percent: int):
    """Links between different components within a tile: overlaps are counted fragment by fragment and summed per pair."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []
        for g in _groups(batches, ["lead", "i", "j"]):
            node, fragment = g.column("node").to_numpy(), g.column("fragment").to_numpy()
            nodes, first, where = np.unique(node, return_index=True, return_inverse=True)
            comps, n, side = (g.column(c).to_numpy()[first] for c in ("comp", "n", "side"))
            a, b = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
            grams = _lists(g, "grams")
            overlap = np.zeros((len(a), len(b)))
            for f in np.unique(fragment):
                sets = [np.zeros(0, dtype=np.int64)] * len(nodes)
                for k in np.flatnonzero(fragment == f):
                    sets[where[k]] = grams[k]
                overlap += _overlaps(sets, a, b)
            hit = 100 * overlap >= percent * (n[a][:, None] + n[b][None, :] - overlap)
            hit &= comps[a][:, None] != comps[b][None, :]
            parent: dict[int, int] = {}

            def root(c: int) -> int:
                while parent.get(c, c) != c:
                    c = parent[c]
                return c

            for i, j in zip(*np.nonzero(hit), strict=True):
                x, y = root(int(comps[a[i]])), root(int(comps[b[j]]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    links.append((x, y))
        yield pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], schema=schema)

    return run


def _tiles(members: DataFrame, tile: int, pivot: bool) -> DataFrame:
    """Deal each leader's nodes to chunks of about ``tile`` and repeat every chunk for each it is to meet: (lead, i, j, side, ...).

    With ``pivot`` one chunk, of nodes of any component, meets all. Else the largest component has chunks of its own that
    don't meet one another, so what is left to compare is as large as what is not in it.
    """
    each = members.groupBy("lead", "comp").agg(F.count(F.lit(1)).alias("size"))
    sizes = each.groupBy("lead").agg(F.sum("size").alias("all"), F.max(F.struct("size", "comp")).alias("top"))
    chunks = lambda n: F.ceil(n / F.lit(tile)).cast("int")
    main = F.lit(0) if pivot else chunks(F.col("top.size"))
    sizes = sizes.select("lead", F.col("top.comp").alias("top"), main.alias("main"), (chunks(F.col("all") if pivot else F.col("all") - F.col("top.size")) + main).alias("chunks"))
    place = F.xxhash64("node", "lead")
    inside = F.lit(False) if pivot else F.col("comp") == F.col("top")
    dealt = members.join(sizes.hint("merge"), "lead").withColumn("chunk", F.when(inside, F.pmod(place, F.col("main"))).otherwise(F.col("main") + F.pmod(place, F.col("chunks") - F.col("main"))).cast("int"))
    meets = F.when(F.col("chunk") == 0, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.lit(0))) if pivot else F.sequence(F.when(inside, F.col("main")).otherwise(0), F.col("chunks") - 1)
    met = dealt.withColumn("other", F.explode(meets))
    side = F.when(F.col("chunk") == F.col("other"), 0).when(F.col("chunk") < F.col("other"), 1).otherwise(2)
    return met.select(*members.columns, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), side.alias("side"))


def _met_in_tiles(members: DataFrame, comps: DataFrame, sets: DataFrame, scratch: Scratch, tile: int, percent: int, pivot: bool) -> DataFrame:
    """Components (node, comp) after those were joined between which a tile has a link."""
    known = members.where("node != lead")
    if not pivot:
        # nodes of one chunk have all met in the first phase
        large = known.groupBy("lead").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") > tile).select("lead")
        known = known.join(large.hint("merge"), "lead", "left_semi")
    known = known.join(comps.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_leads = known.groupBy("lead").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("lead")
    left = scratch.write(known.join(open_leads.hint("merge"), "lead", "left_semi").select("lead", "node", "comp", "n"), "open")
    if left.isEmpty():
        return comps
    tiles = _tiles(left, tile, pivot)
    mixed = tiles.groupBy("lead", "i", "j").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("lead", "i", "j")
    tiles = scratch.write(tiles.join(mixed.hint("merge"), ["lead", "i", "j"], "left_semi"), "tiles")
    one = _together(tiles.join(sets.where("fragment = 0").hint("merge"), "node"))
    near = scratch.write(one.mapInArrow(_near(percent), "lead long, i int, j int, node long"), "near")
    filled = _together(tiles.join(near.hint("merge"), ["lead", "i", "j", "node"], "left_semi").join(sets.hint("merge"), "node"))
    more = scratch.write(filled.mapInArrow(_cross_links(percent), "a long, b long"), "cross")
    scratch.drop(left, tiles, near)
    joined = connected_components(more, scratch)
    old = comps.unionByName(joined.select("node", F.col("node").alias("comp"))).distinct()
    joined = joined.select(F.col("node").alias("comp"), F.col("comp").alias("now"))
    return scratch.write(old.join(joined.hint("merge"), "comp", "left").select("node", F.coalesce("now", "comp").alias("comp")).distinct(), "components")


def in_groups(rows: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """Rows (one per node and key) whose key stands with two nodes at least.

    Keys are counted with partial sums and written; the join with them can be split where a key is hot.
    """
    often = scratch.write(rows.groupBy(key).agg(F.count(F.lit(1)).alias("in")).where(F.col("in") > 1).select(key), "often")
    return rows.join(often.hint("merge"), key, "left_semi")


def _together(df: DataFrame) -> DataFrame:
    """Rows of a tile in one task, one after the other."""
    return df.repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j")


def jaccard_components(
    docs: DataFrame,
    size: int = 5,
    percent: int = 75,
    fragments: int = 4,
    tile: int = 256,
    filter_bits: int = 1 << 23,
) -> DataFrame:
    """The connected components of documents whose sets of word n-grams have a Jaccard index of percent/100 or more.

    Exact. Words are runs of characters other than ASCII white space, A-Z lower-cased; a document's set is
    its distinct runs of ``size`` words (the whole sequence if it has fewer words).

    1. Equal sets become one node, so copies are never paired. The node is a 64-bit hash of the set.
    2. The global order is by hash, with the n-grams found to be frequent last (at most ``MOST_FREQUENT``
       of them, a fixed bound on the broadcast; which ones they are changes the work, not the result).
       Prefixes in this order are a tenth of the set longer than one common n-gram takes, so two linked
       sets have that many (of the smaller set) in common there. Nodes that share fewer n-grams with
       all others together are out.
    3. Of the nodes that share a prefix n-gram, the one with most shared n-grams leads, so any two nodes
       that share one have a leader in common.
    4. Nodes are compared with their leaders: the global order is cut into ``fragments``, partial
       overlaps are counted fragment by fragment and summed per pair.
    5. Where a leader's nodes are still in different components, they meet in tiles of two times ``tile``,
       first by one fragment, then, where the rest could still link them, by all, and only links that join components leave the task.
       First one chunk of them meets all, which joins most of what belongs together at a cost in proportion to their number
       and settles leaders with no more than a chunk; then, of the larger ones, nodes outside the largest component meet all. So no link between components is lost, and pairs inside one component are never emitted.

    Returns doc_id, n_shingles and component_id (smallest doc_id reachable, its own included) for every row.
    Null and empty texts have no n-grams and stand alone. Rows that repeat a doc_id are separate
    texts; null doc_ids take part in links but never give a component its id, unless there is no other (then
    null). An empty table gives no rows. Only doc_id and text are read.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = scratch.write(texts.mapInArrow(_signatures(size), "kind int, doc_id long, n long, sig1 long, sig2 long"), "signatures")
    frequent = first.where("kind = 1").groupBy("sig1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "sig1").limit(MOST_FREQUENT).toPandas()
    grams, ranks = _unsigned(frequent["sig1"].to_numpy(dtype=np.int64)), frequent["n"].to_numpy(dtype=np.int64)
    by_gram = np.argsort(grams)
    only = texts.select("text")
    prefix = only.mapInArrow(_prefixes(size, percent, (grams[by_gram], ranks[by_gram])), "sig1 long, sig2 long, prefix array<long>")
    once = prefix.groupBy("sig1", "sig2").agg(F.first("prefix").alias("prefix"))
    sizes = first.where("kind = 0 and n > 0").groupBy(F.col("sig1").alias("node")).agg(F.first("n").alias("n"))
    once = scratch.write(once.select(F.col("sig1").alias("node"), "prefix"), "prefixes")
    shared = scratch.write(in_groups(once.select("node", F.explode("prefix").alias("gram")), "gram", scratch), "shared")
    scratch.drop(once)
    for _ in range(2):
        enough = shared.groupBy("node").agg(F.count(F.lit(1)).alias("m")).join(sizes.hint("merge"), "node")
        enough = enough.where(F.col("m") >= 1 + F.floor(F.col("n") * percent / 1000)).select("node", F.floor(1000 * F.col("m") / F.col("n")).alias("score"))
        left = scratch.write(shared.select("node", "gram").join(enough.hint("merge"), "node"), "left")
        fewer = scratch.write(in_groups(left, "gram", scratch), "shared")
        scratch.drop(shared, left)
        shared = fewer
    leads = shared.groupBy("gram").agg(F.max(F.struct("score", "node")).alias("lead"))
    members = shared.join(leads.select("gram", F.col("lead.node").alias("lead")).hint("merge"), "gram").select("lead", "node").distinct()
    members = scratch.write(members.join(sizes.hint("merge"), "node"), "members")
    scratch.drop(shared)
    return settle(first.where("kind = 0").select("doc_id", "n", "sig1"), members, only, scratch, size, percent, fragments, tile, filter_bits)


def settle(first: DataFrame, members: DataFrame, only: DataFrame, scratch: Scratch, size: int, percent: int, fragments: int, tile: int, filter_bits: int) -> DataFrame:
    """Components from candidate groups, on full sets of n-grams: steps 4 and 5 of :func:`jaccard_components`.

    ``first`` has doc_id, n and sig1 (the node) of every row, ``members`` (lead, node, n) the nodes of each group, its
    leader included; ``only`` (text) are all texts. Only pairs within a group can be linked.
    """
    sets = _wanted_sets(only, members.select("node").distinct(), scratch, size, fragments, filter_bits)

    heads = members.where("node = lead").select("lead", F.col("n").alias("lead_n"))
    pairs = members.where("node != lead").join(heads.hint("merge"), "lead").where(100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n"))
    theirs = sets.select(F.col("node").alias("lead"), "fragment", F.col("grams").alias("lead_grams"))
    part = (
        pairs.join(sets.hint("merge"), "node")
        .join(theirs.hint("merge"), ["lead", "fragment"])
        .select("lead", "node", "n", "lead_n", F.size(F.array_intersect("grams", "lead_grams")).cast("long").alias("part"))
    )
    overlap = part.groupBy("lead", "node", "n", "lead_n").agg(F.sum("part").alias("overlap"))
    links = scratch.write(overlap.where(100 * F.col("overlap") >= percent * (F.col("n") + F.col("lead_n") - F.col("overlap"))).select(F.col("node").alias("a"), F.col("lead").alias("b")), "links")
    scratch.release()
    comps = scratch.write(connected_components(links, scratch), "components")

    for pivot in (True, False):
        comps = _met_in_tiles(members, comps, sets, scratch, tile, percent, pivot)
    ids = first.where("n > 0").groupBy(F.col("sig1").alias("node")).agg(F.min("doc_id").alias("least"))
    named = ids.join(comps.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("least").alias("component"))
    named = scratch.write(named.join(least.hint("merge"), "comp").select("node", "component"), "named")
    return first.join(named.hint("merge"), first["sig1"] == named["node"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _wanted_sets(texts: DataFrame, wanted: DataFrame, scratch: Scratch, size: int, fragments: int, filter_bits: int) -> DataFrame:
    """Sets of the wanted nodes by fragment. A bit filter of fixed size tells the scan which documents may be wanted; a join drops the rest."""
    words = wanted.mapInArrow(_filter_words(filter_bits), "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(filter_bits // 64, dtype=np.uint64)
    table[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    found = texts.mapInArrow(_fragments(size, fragments, table), "node long, fragment int, grams array<long>")
    return scratch.write(found.groupBy("node", "fragment").agg(F.first("grams").alias("grams")), "sets")


def _filter_words(bits: int):
    schema = pa.schema([("word", pa.int32()), ("bits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits // 64, dtype=np.uint64)
        for batch in batches:
            for at in _bits(batch.column("node").to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(table, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        full = np.flatnonzero(table)
        yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array(table[full].view(np.int64))], schema=schema)

    return run
