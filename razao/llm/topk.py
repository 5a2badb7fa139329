"""Operator 1: exact top-k inner products, pruned by multi-resolution segment statistics.

A vector is cut into equal segments. With the mean m and the deviation d (root of
the squared deviations' mean) of each segment of length L, an inner product is at
most the sum of L * (m m' + d d'); in distances, |q-x|^2 is at least the sum of
L * ((m-m')^2 + (d-d')^2). Bounds are taken for one segment, then four, then
sixteen, each for the pairs that the coarser bound left, and the exact product
for what remains.

Work is dealt in tiles: a block of queries meets a block of candidates in one
task, whose memory is bounded by the block sizes. A tile's answer is k rows a
query at most; the last k are chosen by a window over the query.

Defined results: a vector that is null or holds a null, NaN or infinite
component takes no part, nor does a row without id; rows that repeat an id count
once (the smallest vector); only vectors of the same length meet; products
beyond a long are cut to its limits; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

LEVELS = (1, 4, 16)
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192
#: Candidates that a task bounds at a time, after a short first step that sets the thresholds.
STEP = 1024


def quantized(df: DataFrame, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<bigint>) with floor(scale * x) of every component, of the rows that take part."""
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    ok = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return (df.where(F.col(id_col).isNotNull() & F.coalesce(ok, F.lit(False)))
            .groupBy(F.col(id_col).alias("vec_id"))
            .agg(F.min(F.transform(x, lambda e: F.floor(e * scale).cast("bigint"))).alias("v")))


def statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """Root-of-length weighted segment means, then deviations: their product bounds the inner product."""
    cuts = np.array_split(np.arange(v.shape[1]), min(segments, v.shape[1]))
    means = np.stack([v[:, c].mean(1) * len(c) ** 0.5 for c in cuts], 1)
    devs = np.stack([v[:, c].std(1) * len(c) ** 0.5 for c in cuts], 1)
    return np.concatenate([means, devs], 1)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products as longs."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2.0 ** 53:
        return (q.astype(float) @ c.T.astype(float)).astype(np.int64)
    if most < 2.0 ** 62:
        return q @ c.T
    return np.clip(q.astype(object) @ c.T.astype(object), -(2 ** 63), 2 ** 63 - 1).astype(np.int64)


def best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best rows of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score.astype(float), query)) if np.abs(score).max(initial=0) < 2 ** 53 else np.array(
        sorted(range(len(ids)), key=lambda i: (query[i], -int(score[i]), ids[i])), np.int64)
    query = query[order]
    start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.array([], np.int64)
    place = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
    order = order[place < k]
    return query[place < k], ids[order], score[order]


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best candidates of each query of one tile: (query row, id, score)."""
    order = np.argsort(-(c.astype(float) ** 2).sum(1), kind="stable")  # long vectors first: thresholds rise early
    c_ids, c = c_ids[order], c[order]
    levels = [(statistics(q.astype(float), s), statistics(c.astype(float), s)) for s in LEVELS] if q.shape[1] else []
    slack = [1e-9 * (1 + np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]) for a, b in levels]
    least = np.full(len(q), -np.inf)  # the k-th best score so far
    best = (np.array([], np.int64), c_ids[:0], np.array([], np.int64))
    at, step = 0, max(2 * k, 64)
    while at < len(c):
        to = min(len(c), at + step)
        rows, cols = np.arange(len(q)), np.arange(at, to)
        alive = np.ones((len(q), to - at), bool)
        for (a, b), s in zip(levels, slack):
            alive &= a[rows] @ b[cols].T + s >= least[rows, None]
            r, x = alive.any(1), alive.any(0)
            rows, cols, alive = rows[r], cols[x], alive[r][:, x]
        if alive.size:
            score = products(q[rows], c[cols])
            alive &= (score >= least[rows, None]) & (c_ids[cols][None] != q_ids[rows, None])
            i, j = np.nonzero(alive)
            best = best_of(np.r_[best[0], rows[i]], np.r_[best[1], c_ids[cols[j]]], np.r_[best[2], score[i, j]], k)
            count = np.bincount(best[0], minlength=len(q))
            last = np.cumsum(count) - 1
            full = count >= k
            least[full] = best[2][last[full]]
        at, step = to, STEP
    return best


def vectors(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    v = t.column("v").combine_chunks()
    return t.column("vec_id").to_numpy(), v.flatten().to_numpy().reshape(len(t), -1)


def top_k(df: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every row for which ``is_query`` (over vec_id) holds."""
    from .common import written

    rows = written(quantized(df, scale).withColumn("dim", F.size("v")), "vectors")
    n, nq = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    q_blocks, c_blocks = max(1, -(-nq // QUERY_BLOCK)), max(1, -(-n // CANDIDATE_BLOCK))
    spread = F.xxhash64("vec_id")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    queries = rows.where(is_query).select("vec_id", "v", "dim", F.pmod(spread, F.lit(q_blocks)).cast("int").alias("qb"), every(c_blocks).alias("cb"))
    others = rows.select("vec_id", "v", "dim", every(q_blocks).alias("qb"), F.pmod(spread, F.lit(c_blocks)).cast("int").alias("cb"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            out = (np.array([], np.int64),) * 3
        else:
            (q_ids, q), (c_ids, c) = vectors(left), vectors(right)
            row, ids, score = tile(q_ids, q, c_ids, c, k)
            out = (q_ids[row], ids, score)
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    key = ["dim", "qb", "cb"]
    met = queries.groupBy(*key).cogroup(others.groupBy(*key)).applyInArrow(meet, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
