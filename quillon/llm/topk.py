"""Exact top-k search by inner product: columnar branch and bound.

Queries and candidates are dealt into blocks of bounded bytes; every pair of a query block and a candidate block is one
group, as an exact search has to set every query against every candidate. In a group the candidates lie dimension by
dimension (vertical layout), the dimensions of most mass first. Scores are accumulated for DIMS dimensions at a time.
What is left of a candidate's score is at most the product of the two remaining norms (Cauchy-Schwarz); after every
block of dimensions, the first one included, a candidate whose partial score plus that bound is below the query's k-th
best known score is dropped. That score is the exact one of the candidates that are best so far, looked up after the
first block and again while it rises. As soon as no more than COMPACT of the pairs survive, every query's survivors are
compacted, and again after every further block, so dropped candidates cost nothing more. Components are integers in
float64, so scores are exact up to 2^53, and equal scores are never dropped by the bound.

Cases: vectors that are null, empty, or hold null or non-finite components take no part; vectors of different lengths
do not meet; a repeated query id is asked once, with its smallest vector, and never finds its own id; repeated
candidates count as often as they occur; fewer than k candidates give fewer rows; empty tables give none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least rows in a block of candidates, most bytes in a block of either side; dimensions in a block; queries scored at once.
CANDIDATES, BYTES, DIMS, AT_ONCE = 4096, 1 << 25, 8, 64
#: Share of surviving pairs from which they are compacted.
COMPACT = 0.5


def grid(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component as double arithmetic; null if the vector takes no part."""
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when((F.size(vector) > 0) & fit, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def search_block(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int, work: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query ids, candidate ids and scores of each query's k best in this block, ties to smaller candidate ids.

    work, if given, gets the number of pairs and dimensions multiplied for each block of dimensions.
    """
    order = np.argsort(-np.square(c).sum(0) * np.square(q).sum(0), kind="stable")
    q, columns = q[:, order], np.ascontiguousarray(c[:, order].T)
    by_id = np.argsort(c_id, kind="stable")
    c_id, columns = c_id[by_id], np.ascontiguousarray(columns[:, by_id])
    dims, n, found = len(columns), len(c_id), ([], [], [])
    starts = list(range(0, dims, DIMS))
    # norms of the dimensions from each block on
    c_rest = np.sqrt(np.stack([np.square(columns[d:]).sum(0) for d in starts]))
    q_rest = np.sqrt(np.stack([np.square(q[:, d:]).sum(1) for d in starts], 1)) * (1 + 1e-9)
    count = (lambda pairs, d: work.append(pairs * min(DIMS, dims - d))) if work is not None else lambda pairs, d: None
    for lo in range(0, len(q), AT_ONCE):
        part, ids, rest = q[lo : lo + AT_ONCE], q_id[lo : lo + AT_ONCE], q_rest[lo : lo + AT_ONCE]
        score = np.zeros((len(part), n))
        for i, (x, y) in enumerate(zip(np.searchsorted(c_id, ids), np.searchsorted(c_id, ids, "right"))):
            score[i, x:y] = -np.inf  # a query never finds its own id
        least, rising, alive, at = np.full(len(part), -np.inf), True, None, 0
        while at < len(starts):
            d = starts[at]
            score += part[:, d : d + DIMS] @ columns[d : d + DIMS]
            count(score.size, d)
            at += 1
            if at == len(starts) or n <= k:
                continue
            if rising:
                best = np.argpartition(score, n - k, axis=1)[:, n - k :]
                exact = np.einsum("qd,dqk->qk", part, columns[:, best])
                exact[np.take_along_axis(score, best, 1) == -np.inf] = -np.inf
                now = np.maximum(least, exact.min(1))
                rising, least = bool((now > least).any()), now
            alive = score >= least[:, None] - rest[:, at, None] * c_rest[at]
            if np.count_nonzero(alive) <= COMPACT * score.size:
                break
        done = at == len(starts)
        for i in range(len(part)):
            ci = np.flatnonzero(score[i] >= least[i] if done else alive[i])
            s = score[i, ci]
            for b in range(at, len(starts)):  # only the survivors go on
                d = starts[b]
                s += part[i, d : d + DIMS] @ columns[d : d + DIMS, ci]
                count(len(ci), d)
                keep = s >= least[i] - (rest[i, b + 1] * c_rest[b + 1, ci] if b + 1 < len(starts) else 0)
                ci, s = ci[keep], s[keep]
            known = s > -np.inf
            ci, s = ci[known], s[known]
            top = np.lexsort((ci, -s))[:k]
            for out, x in zip(found, (np.full(len(top), ids[i]), c_id[ci[top]], s[top])):
                out.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in found)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """query_id, rank, vec_id and score of the k candidates of highest inner product for each query, ties to smaller ids.

    vector: an array of long that is null in rows that take no part (see grid()).
    """
    spark = candidates.sparkSession
    c = candidates.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    q = queries.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(vector).alias("v"))
    size = lambda df: df.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    (n, n_values), (_, m_values) = size(c), size(q)
    n_c = max(1, -(-8 * n_values // BYTES), min(2 * spark.sparkContext.defaultParallelism, -(-n // CANDIDATES)))
    n_q = max(1, -(-8 * m_values // BYTES))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return df.select("id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias(other))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
            ids = lambda t: t.column("id").to_numpy()
            found = search_block(ids(left), matrix(left), ids(right), matrix(right), k)
        else:
            found = (np.zeros(0),) * 3
        return pa.table({n: pa.array(x.astype(np.int64)) for n, x in zip(("query_id", "vec_id", "score"), found)})

    keys = ("dims", "qb", "cb")
    each = dealt(q, "qb", n_q, "cb", n_c).groupBy(*keys).cogroup(dealt(c, "cb", n_c, "qb", n_q).groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same rows by DuckDB.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
