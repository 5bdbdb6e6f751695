"""Exact top-k inner-product search by columnar branch and bound.

Queries and candidates are cut into blocks of bounded size and every query
block meets every candidate block in one task (the stated query set against
all rows). There the candidates lie in vertical layout, one row per
dimension, and each query adds its products dimension block by block. After
a block the mass that the remaining dimensions can still add is bounded by
Cauchy-Schwarz, ``|q_rest| * |c_rest|``; candidates whose partial score plus
bound cannot reach the query's k-th best known score are dropped and the rest
compacted. What survives all blocks has its exact integer score. The k best of
every candidate block are then ranked per query.

Components are ``floor(256 * x)`` with x as double. Defined results: a null
vector or one holding a null, NaN or infinity takes no part; a shorter vector
counts as padded with zeros; every row with the query's own id is left out;
ties go to the smaller id; repeated rows are candidates of their own, and a
repeated query row is asked once (its smallest vector by order); a score
beyond 2^63 - 1 either way is clipped to it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256.0
EXACT = float(1 << 53)
MOST = int(np.iinfo(np.int64).max)


def whole(y: Column) -> Column:
    """floor as a double; doubles from 2^53 on are whole already, and may not fit a long."""
    return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)


def quantised(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key as ``id`` and ``v``, the array of floor(256 x) as double, of the rows that take part."""
    x = F.col(column)
    sound = F.col(key).isNotNull() & x.isNotNull() & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return vectors.filter(F.coalesce(sound, F.lit(False))).select(
        F.col(key).cast("long").alias("id"),
        F.transform(F.transform(x, lambda e: F.lit(SCALE) * e.cast("double")), whole).alias("v"))


def _matrix(rows: list, dims: int) -> np.ndarray:
    out = np.zeros((dims, len(rows)))
    for j, r in enumerate(rows):
        out[: len(r), j] = r
    return out


def _exact(q: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """Integer inner products of q with the columns of cand."""
    if float(np.abs(q).sum()) * float(np.abs(cand).max(initial=0.0)) < EXACT:
        return (q @ cand).astype(np.int64)  # every partial sum is exact in a double
    whole = [sum(int(a) * int(b) for a, b in zip(q, c)) for c in cand.T]
    return np.array([min(max(s, -MOST), MOST) for s in whole], dtype=np.int64)


def search_block(q_ids, q_rows, c_ids, c_rows, k: int, block: int):
    """The k best (query id, candidate id, score) of one query and one candidate block."""
    dims = max((len(r) for r in [*q_rows, *c_rows]), default=0)
    order = np.argsort(np.asarray(c_ids), kind="stable")
    c_ids = np.asarray(c_ids, dtype=np.int64)[order]
    cand = _matrix([c_rows[i] for i in order], dims)
    queries = _matrix(q_rows, dims)
    cuts = [(lo, min(dims, lo + block)) for lo in range(0, dims, block)]
    # norm of what follows each cut, rounded up so that the bound stays a bound
    rest = [np.sqrt((cand[hi:] ** 2).sum(axis=0)) * (1 + 1e-9) for _, hi in cuts]
    largest = float(np.abs(cand).max(initial=0.0))
    for j, qid in enumerate(q_ids):
        q = queries[:, j]
        alive = np.flatnonzero(c_ids != qid)
        partial = np.zeros(len(alive))
        floor = -np.inf
        # beyond the integers that doubles hold exactly, scores are clipped: nothing is dropped then
        exact = float(np.abs(q).sum()) * largest < EXACT
        for i, (lo, hi) in enumerate(cuts):
            partial = partial + q[lo:hi] @ cand[lo:hi, alive]
            if hi == dims or len(alive) <= k or not exact:
                continue
            if i == 0:  # exact scores of the most promising few give the first floor
                seeds = alive[np.argpartition(-partial, k - 1)[: 4 * k]] if len(alive) > 4 * k else alive
                floor = float(np.sort(_exact(q, cand[:, seeds]))[-k])
            bound = partial + np.sqrt((q[hi:] ** 2).sum()) * (1 + 1e-9) * rest[i][alive]
            keep = bound * (1 + np.sign(bound) * 1e-9) + 1e-3 >= floor
            alive, partial = alive[keep], partial[keep]
        score = _exact(q, cand[:, alive])
        best = np.lexsort((c_ids[alive], -score))[:k]
        for b in best:
            yield qid, int(c_ids[alive[b]]), int(score[b])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, query_rows: int = 1024,
          candidate_rows: int = 4096, dim_block: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score. Both frames hold ``id, v`` (see ``quantised``).

    A task holds one query block and one candidate block; the number of
    blocks follows the row counts, their size does not.
    """
    asked = queries.groupBy("id").agg(F.min("v").alias("v"))
    n_c, n_q = vectors.count(), asked.count()
    c_blocks, q_blocks = max(1, -(-n_c // candidate_rows)), max(1, -(-n_q // query_rows))

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return (df.withColumn(own, F.pmod(F.xxhash64("id", "v"), F.lit(n_own)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))))

    left = dealt(asked, "qb", q_blocks, "cb", c_blocks).groupBy("qb", "cb")
    right = dealt(vectors, "cb", c_blocks, "qb", q_blocks).groupBy("qb", "cb")

    def run(q, c):
        import pyarrow as pa
        found = []
        if q.num_rows and c.num_rows:
            found = list(search_block(q.column("id").to_pylist(), q.column("v").to_pylist(),
                                      c.column("id").to_pylist(), c.column("v").to_pylist(), k, dim_block))
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()),
                         "vec_id": pa.array([f[1] for f in found], pa.int64()),
                         "score": pa.array([f[2] for f in found], pa.int64())})

    local = left.cogroup(right).applyInArrow(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
