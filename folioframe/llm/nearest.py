"""Nearest neighbours by largest inner product, as a block matrix join with quantised bounds.

Queries and rows are cut into blocks; every pair of blocks is a tile. In a tile, vectors are rounded to int8 with a
scale each, and one product of the int8 matrices gives all inner products up to a bound that follows from the rounding
errors' norms. A pair whose upper bound is below the k-th best lower bound of its query can't be among the k; the
others are computed in double precision from the original vectors, and a heap for each query merges what the parts of a
tile leave. At most k rows of each query and tile leave it, and the best k of those are the result, so it is exact.

Blocks are bounded in rows and in bytes. Every vector is divided by its largest component before anything is squared, so
components of any finite size are told apart; bounds that overflow keep the pair.

Defined results: vectors that are null, empty, all zero, or hold a null or a non-finite component take no part; vectors
of different sizes are never compared; rows of the query's own id are no candidates; ties go to the smaller id; with
fewer candidates than k, all of them come back; repeated candidate rows count each; a score that overflows is infinite.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and rows in a tile at most: every row is shuffled once for each block of queries, so large blocks are cheap.
QUERY_BLOCK = 8192
ROW_BLOCK = 65536
BLOCK_BYTES = 256 << 20
LEAST_BLOCK = 1024
PART = 4096


def usable(v: Column) -> Column:
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & ok & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def quantised(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, the largest components, and of the rows divided by these: the norms of what rounding lost, and the norms
    of the rounded rows."""
    wide = m.astype(np.float64)
    top = np.abs(wide).max(1)
    unit = wide / top[:, None]
    codes = np.rint(unit * 127)
    near = codes / 127
    return codes.astype(np.int8), top, np.linalg.norm(unit - near, axis=1), np.linalg.norm(near, axis=1)


def tile(q_ids: np.ndarray, q: np.ndarray, r_ids: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of r for each of q: index of the query, id, score."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(q))]
    kind = np.float32 if q.shape[1] * 127 * 127 < 2**24 else np.float64  # products of int8 stay exact in it
    qc, qs, qe, qn = quantised(q)
    wide_q = q.astype(np.float64)
    least_step = q.shape[1] * 5e-324
    for lo in range(0, len(r), PART):
        part, ids = r[lo : lo + PART], r_ids[lo : lo + PART]
        rc, rs, re, rn = quantised(part)
        wide = part.astype(np.float64)
        for a in range(0, len(q), 512):
            b = min(a + 512, len(q))
            about = (qc[a:b].astype(kind) @ rc.T.astype(kind)).astype(np.float64) / (127 * 127)
            # |q.r - q'.r'| <= |q - q'||r| + |q'||r - r'|, and a little for the doubles' own rounding
            slack = qe[a:b, None] * (rn + re)[None, :] + qn[a:b, None] * re[None, :] + 1e-12 * (qn + qe)[a:b, None] * (rn + re)[None, :]
            with np.errstate(over="ignore", invalid="ignore"):
                both = qs[a:b, None] * rs[None, :]
                low, high = (about - slack) * both - least_step, (about + slack) * both + least_step
            low[np.isnan(low)], high[np.isnan(high)] = -np.inf, np.inf
            own = q_ids[a:b, None] == ids[None, :]
            low[own], high[own] = -np.inf, -np.inf
            low[low == np.inf] = -np.inf  # proves nothing: sums may overflow on the way
            least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(b - a, -np.inf)
            least = np.maximum(least, [h[0][0] if len(h := heaps[i]) == k else -np.inf for i in range(a, b)])
            i, j = np.nonzero((high >= least[:, None]) & ~own)
            score = np.empty(len(i))
            for c in range(0, len(i), 65536):
                with np.errstate(over="ignore", invalid="ignore"):
                    score[c : c + 65536] = (wide_q[a + i[c : c + 65536]] * wide[j[c : c + 65536]]).sum(1)
            for x, s, n in zip((a + i).tolist(), score.tolist(), ids[j].tolist()):
                item = (s, -n)
                if len(heaps[x]) < k:
                    heapq.heappush(heaps[x], item)
                elif item > heaps[x][0]:
                    heapq.heapreplace(heaps[x], item)
    index = np.repeat(np.arange(len(q)), [len(h) for h in heaps])
    flat = [x for h in heaps for x in h]
    return index, -np.array([n for _, n in flat], np.int64), np.array([s for s, _ in flat], np.float64)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank, id and score of the k nearest rows of every row that is_query picks."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    n = rows.agg(F.count("*"), F.count_if("q"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    query_block, row_block = (max(1, min(b, BLOCK_BYTES // (8 * n[2]))) for b in (query_block, row_block))
    n_queries = max(1, math.ceil(n[1] / query_block))
    tiles = math.ceil(vectors.sparkSession.sparkContext.defaultParallelism / n_queries)  # few rows are still cut finely enough for all cores
    n_rows = max(1, math.ceil(n[0] / row_block), min(tiles, math.ceil(n[0] / LEAST_BLOCK)))
    block = lambda m, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    base = rows.select("id", "v", F.size("v").alias("dim"), block(n_rows, 1).alias("b"), every(n_queries).alias("qb"))
    asked = rows.where("q").select("id", "v", F.size("v").alias("dim"), every(n_rows).alias("b"), block(n_queries, 2).alias("qb"))
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        dim = key[0].as_py()
        q_ids = left.column("id").to_numpy()
        i, ids, score = tile(q_ids, _matrix(left.column("v"), dim), right.column("id").to_numpy(), _matrix(right.column("v"), dim), k)
        return pa.Table.from_arrays([pa.array(q_ids[i]), pa.array(ids), pa.array(score)], schema=schema)

    key = ("dim", "b", "qb")
    found = asked.groupBy(*key).cogroup(base.groupBy(*key)).applyInArrow(run, "query_id bigint, id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")
