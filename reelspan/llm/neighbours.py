"""Exact nearest neighbours by a block matrix join with int8 tiles."""

from __future__ import annotations

import heapq
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Products of int8 values are summed in float32 over at most this many dimensions, so every sum is exact.
_EXACT_DIMS = 1024
#: Queries of a tile whose bounds are held at once.
QUERIES_AT_ONCE = 256


def usable(vector: str) -> Column:
    """True for vectors that are not null, not all zero, and hold only finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _quantise(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integer rows in -127..127, their scales, and the length of what rounding lost."""
    scale = np.abs(m).max(axis=1) / 127.0
    scale = np.where(scale > 0, scale, 1.0)
    q = np.rint(m / scale[:, None])
    lost = np.sqrt(((m - q * scale[:, None]) ** 2).sum(axis=1))
    return q.astype(np.int8), scale, lost


def _tile_bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all distances between rows of a and of b."""
    with np.errstate(over="ignore", invalid="ignore"):
        return _bounds(a, b)


def _bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    qa, sa, la = _quantise(a)
    qb, sb, lb = _quantise(b)
    dot = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], _EXACT_DIMS):
        dot += qa[:, k : k + _EXACT_DIMS].astype(np.float32) @ qb[:, k : k + _EXACT_DIMS].astype(np.float32).T
    na = (qa.astype(np.float64) ** 2).sum(axis=1) * sa**2
    nb = (qb.astype(np.float64) ** 2).sum(axis=1) * sb**2
    near = np.sqrt(np.maximum(na[:, None] + nb[None, :] - 2 * dot * sa[:, None] * sb[None, :], 0))
    slack = la[:, None] + lb[None, :] + 1e-7 * (np.sqrt(na)[:, None] + np.sqrt(nb)[None, :])
    low, high = near - slack, near + slack
    low[~(low > 0)], high[np.isnan(high)] = 0, np.inf  # where squares overflow nothing is known
    return low, high


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of row pairs, components summed in order."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore"):
        for k in range(a.shape[1]):
            d = a[:, k] - b[:, k]
            total += d * d
    return np.sqrt(total)


def _nearest_rows(qm: np.ndarray, q_id: np.ndarray, rm: np.ndarray, r_id: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(place of the query, vec_id, distance): the k nearest rows of another id for each query, all if there are fewer."""
    low, high = _tile_bounds(qm, rm)
    own = q_id[:, None] == r_id[None, :]
    high[own] = np.inf
    limit = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] > k else np.full(len(qm), np.inf)
    at, to = np.nonzero((low <= limit[:, None]) & ~own)
    score = _exact(qm[at], rm[to])
    start = np.searchsorted(at, np.arange(len(qm) + 1))
    found = []
    for i, (a, b) in enumerate(zip(start[:-1], start[1:], strict=True)):
        found += [(i, v, s) for s, v in heapq.nsmallest(k, zip(score[a:b], r_id[to[a:b]], strict=True))]
    return found


def _search_tile(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int, float]] = []
        if len(queries) and len(rows):
            q_dims, r_dims = queries["vector"].map(len).to_numpy(), rows["vector"].map(len).to_numpy()
            for dims in np.unique(q_dims):
                q, r = queries[q_dims == dims], rows[r_dims == dims]
                if not len(r):
                    continue
                qm, rm = np.stack(q["vector"].to_numpy()).astype(np.float64), np.stack(r["vector"].to_numpy()).astype(np.float64)
                q_id, q_row, r_id = q["vec_id"].to_numpy(), q["row"].to_numpy(), r["vec_id"].to_numpy()
                for part in range(0, len(q), QUERIES_AT_ONCE):
                    for i, v, s in _nearest_rows(qm[part : part + QUERIES_AT_ONCE], q_id[part : part + QUERIES_AT_ONCE], rm, r_id, k):
                        found.append((q_row[part + i], q_id[part + i], v, s))
        return pd.DataFrame(found, columns=["row", "query_id", "vec_id", "score"]).astype({"row": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    vector: str = "embedding",
    row_block: int = 4096,
    query_block: int = 4096,
) -> DataFrame:
    """The k nearest rows of every query by Euclidean distance; exact.

    Rows and queries are hashed to blocks of about ``row_block`` and ``query_block`` vectors. Each pair of
    blocks is one tile: int8 products give a distance with a bound on its quantisation error; only pairs
    whose lower bound is within the k-th smallest upper bound are recomputed in double precision, and a
    heap keeps the tile's best k per query. The heaps are merged per query by rank, at most k rows of each
    tile. A tile is all that a task holds, whatever the table's size. Each row is sent once per block of
    queries and each query once per block of rows.

    Vectors that are null, all zero or hold null or non-finite components take no part, as do rows without
    vec_id. A query is compared with vectors of its own length only, and with no row of its own vec_id. Every row counts, also
    where a vec_id repeats: a repeated candidate takes several ranks, a repeated query is asked for each of its
    rows, with ranks of its own. Ties go to the smaller vec_id. With fewer than k candidates all are returned, with none no row;
    empty tables give no rows. Distances that overflow are infinite. Only vec_id and the vector column are read.
    """
    scratch = Scratch(vectors.sparkSession, "nearest")

    def clean(df: DataFrame) -> DataFrame:
        return df.where(F.col("vec_id").isNotNull() & usable(vector)).select("vec_id", F.col(vector).alias("vector"))

    rows, asked = scratch.write(clean(vectors), "rows"), scratch.write(clean(queries).withColumn("row", F.monotonically_increasing_id()), "queries")
    n_rows, n_asked = max(1, -(-rows.count() // row_block)), max(1, -(-asked.count() // query_block))
    block = lambda n: F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n)).cast("int")
    left = asked.withColumn("j", F.pmod(F.xxhash64("row"), F.lit(n_asked)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    right = rows.withColumn("i", block(n_rows)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    tiles = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(_search_tile(k), "row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("row").orderBy("score", "vec_id")
    return tiles.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
