"""Exact top-k search by vector approximations.

Candidates are dealt into blocks and queries into groups, both of bounded size, and every block meets every
group: the stated queries against all rows, in blocks. In a block each dimension is cut into cells that hold
about as many values each, and a vector is approximated by the numbers of its cells. Scanning these gives bounds on
every score; vectors whose upper bound is below the kth lower bound are out. The exact vectors of the others
are read in the order of their upper bounds until no bound reaches the kth score. The best of each block are
merged by rank, of which Spark keeps only ``k`` rows per query and task.

Cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id; of rows
with one id the least vector stands for it; vectors of different lengths are not compared; a query with
fewer than k candidates gets all; ties go to the smaller id; other columns are not read; no rows give
no rows. Scores beyond 64 bits become the largest or smallest long.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, GROUP, CELLS, CHUNK = 8192, 4096, 64, 128


def cells(v: np.ndarray, number: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell numbers, least value, largest value of each cell) per dimension; cells hold about equally many values."""
    n, d = v.shape
    ordered = np.sort(v, axis=0)
    edges = ordered[(np.arange(1, number) * n) // number]  # the first value of each further cell
    at = np.empty((n, d), dtype=np.uint8)
    low = np.empty((number, d), dtype=np.float64)
    high = np.empty((number, d), dtype=np.float64)
    for j in range(d):
        at[:, j] = np.searchsorted(edges[:, j], v[:, j], "right")
        place = np.searchsorted(ordered[:, j], edges[:, j], "left")
        first = np.append(0, place)
        last = np.maximum(np.append(place, n) - 1, first.clip(max=n - 1))
        low[:, j], high[:, j] = ordered[first.clip(max=n - 1), j], ordered[last, j]
    return at, low, high


def exact(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, without overflow."""
    if not v.size or float(np.abs(v.astype(np.float64)).max()) * float(np.abs(q.astype(np.float64)).max()) * v.shape[1] < 2.0**62:
        return v @ q
    whole = v.astype(object) @ q.astype(object)
    return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in whole], dtype=np.int64)


def best(ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score) of each query's best ``k`` in the block."""
    found: list[tuple[int, int, int]] = []
    if not len(v) or not len(q):
        return found
    if v.shape[1] == 0:
        at, middle, half = None, np.zeros((len(v), 0)), np.zeros((len(v), 0))
    else:
        at, low, high = cells(v)
        columns = np.arange(v.shape[1])
        least, most = low[at, columns], high[at, columns]
        middle, half = least / 2 + most / 2, most / 2 - least / 2
    for a in range(0, len(q), CHUNK):
        some = q[a : a + CHUNK].astype(np.float64)
        score, reach = some @ middle.T, np.abs(some) @ half.T
        # room for rounding: a few units in the last place of the largest sums
        reach += 1e-9 * (np.abs(some) @ np.abs(middle).T + reach) + 1e-6
        for i in range(len(some)):
            query = int(query_ids[a + i])
            upper, lower = np.clip(score[i] + reach[i], -(2.0**63), 2.0**63), np.clip(score[i] - reach[i], -(2.0**63), 2.0**63)
            own = np.flatnonzero(ids == query)
            upper[own] = lower[own] = -np.inf  # below any score
            others = len(ids) - len(own)
            if not others:
                continue
            kth = np.partition(lower, len(lower) - k)[len(lower) - k] if others >= k and len(lower) > k else -np.inf
            order = np.flatnonzero((upper >= kth) & (upper > -np.inf))
            order = order[np.argsort(-upper[order], kind="stable")]
            seen_ids, seen = ids[:0], np.zeros(0, dtype=np.int64)
            for x in range(0, len(order), 4 * k):
                if len(seen) >= k and upper[order[x]] < seen[k - 1]:
                    break
                more = order[x : x + 4 * k]
                seen_ids = np.concatenate([seen_ids, ids[more]])
                seen = np.concatenate([seen, exact(v[more], q[a + i])])
                rank = np.lexsort((seen_ids, ~seen))[:k]  # ~ turns the order without overflow
                seen_ids, seen = seen_ids[rank], seen[rank]
            found += [(query, int(c), int(s)) for c, s in zip(seen_ids, seen, strict=True)]
    return found


def whole_numbers(vector: str, factor: int) -> Column:
    """floor(factor * x) of each component, null for vectors that take no part."""
    fine = f"forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return F.expr(f"if({fine}, transform({vector}, x -> floor({factor} * cast(x as double))), null)")


def search(
    rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 64,
    block: int = BLOCK, group: int = GROUP,
) -> DataFrame:
    """query_id, rank, vec_id, score: the best ``k`` other rows for each row with ``is_query``.

    Vectors are turned into whole numbers, floor(factor * x); the score is their inner product.
    """
    named = rows.select(F.col(id_col).cast("long").alias("id"), whole_numbers(f"`{vector_col}`", factor).alias("v"), is_query.alias("is_query"))
    own = named.where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"), F.max("is_query").alias("is_query"))
    sized = own.withColumn("d", F.size("v"))
    n, queries = sized.agg(F.count(F.lit(1)), F.sum(F.col("is_query").cast("int"))).first()
    blocks, groups = max(1, math.ceil(n / block)), max(1, math.ceil((queries or 0) / group))
    deal = F.xxhash64("id")
    each = lambda number: F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    left = sized.select("id", "v", "d", F.pmod(deal, F.lit(blocks)).cast("int").alias("b"), each(groups).alias("g"))
    right = sized.where("is_query").select("id", "v", "d", F.pmod(deal, F.lit(groups)).cast("int").alias("g"), each(blocks).alias("b"))

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = t.column("id").to_numpy()
        v = t.column("v").combine_chunks()
        flat = v.flatten().to_numpy(zero_copy_only=False) if len(v) else np.zeros(0, np.int64)
        return ids, flat.reshape(len(ids), -1) if len(flat) else np.zeros((len(ids), 0), np.int64)

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        found = best(*matrix(x), *matrix(y), k)
        cols = list(zip(*found, strict=True)) if found else [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.int64())})

    keys = ["b", "g", "d"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
