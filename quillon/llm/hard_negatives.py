"""Hard-negative mining by a full sort of every anchor's integer scores.

Anchors and rows are dealt into blocks of bounded bytes, and every block of anchors meets every block of rows. There a
row's score is its integer inner product with the anchor, and an anchor's scores are sorted once (score descending, then
id: a lexicographic sort). From that order come, in a first pass, its best rows of the same label; the best of all
blocks are its positives. In a second pass each positive's upper limit is found in the order of the different-label
entries by binary search, and the next k entries that are not below its lower limit are read. A negative among an
anchor's first k of all rows is among the first k of its own block, so the blocks' results are merged exactly.

Scores are exact: products are summed in float64 while their sum stays below 2^53, else in 64-bit integers, else in
Python's; a score has to fit 64 bits.

Cases: rows with a null id, label or vector, or a null or non-finite component take no part; vectors of different
lengths do not meet, empty ones have score 0 with each other; a repeated anchor id is asked once, by its smallest vector
and label, and never finds its own id; repeated rows count as often as they occur, as positives too; fewer positives or
negatives give fewer rows; a negative positive score has no range, so no row; an empty table gives none; extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least rows in a block, most bytes in a block of either side; anchors scored at once.
ROWS, BYTES, AT_ONCE = 4096, 1 << 25, 64
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95


def grid(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as double arithmetic; null if the vector takes no part."""
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fit, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    largest = [max(abs(int(m.min())), abs(int(m.max()))) for m in (a, b)]
    most = largest[0] * largest[1] * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def ordered_scores(anchor_ids: np.ndarray, anchors: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor its number, the other rows' places in order of score (descending) and id, and their scores."""
    for lo in range(0, len(anchors), AT_ONCE):
        scores = inner_products(anchors[lo : lo + AT_ONCE], rows)
        for i, s in enumerate(scores, lo):
            order = np.lexsort((ids, -s))
            order = order[ids[order] != anchor_ids[i]]
            yield i, order, s[order]


def in_range(scores: np.ndarray, positive: int, k: int, low: int, high: int) -> slice:
    """Where in descending scores the first k lie that are at most high and at least low hundredths of a positive's score."""
    least, most = -(-low * positive // 100), high * positive // 100
    start = int(np.searchsorted(-scores, -most, "left"))  # the first that is not above the upper limit
    end = int(np.searchsorted(-scores[start : start + k], -least, "right"))
    return slice(start, start + end)


def mine(rows: DataFrame, anchors: DataFrame, key: str = "vec_id", vector: str = "vector", label: str = "label", positives: int = POSITIVES, k: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_rank, positive_id, rank, negative_id, positive_score and negative_score.

    vector: an array of long that is null in rows that take no part (see grid()). The first k rows of another label
    whose score is between low and high hundredths of the positive's are its negatives.
    """
    spark = rows.sparkSession
    part = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.col(label).cast("long").alias("label")).where("id IS NOT NULL AND v IS NOT NULL AND label IS NOT NULL")
    c = part(rows)
    a = part(anchors).groupBy("id").agg(F.min(F.struct("v", "label")).alias("r")).select("id", "r.*")
    size = lambda df: df.agg(F.count("*"), F.coalesce(F.sum(F.size("v") + 2), F.lit(0))).first()
    (n, n_values), (_, m_values) = size(c), size(a)
    n_c = max(1, -(-8 * n_values // BYTES), min(2 * spark.sparkContext.defaultParallelism, -(-n // ROWS)))
    n_a = max(1, -(-8 * m_values // BYTES))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return df.withColumns({"dims": F.size("v"), own: F.pmod(F.xxhash64("id"), F.lit(blocks)), other: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long")))})

    def column(t: pa.Table, name: str) -> np.ndarray:
        return t.column(name).to_numpy()

    def matrix(t: pa.Table) -> np.ndarray:
        return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(t.num_rows, int(column(t, "dims")[0]))

    def table(names: list[str], found: list[tuple]) -> pa.Table:
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(names, zip(*found) if found else [()] * len(names))})

    def same_label(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, labels = column(right, "id"), column(right, "label")
            for i, order, scores in ordered_scores(own := column(left, "id"), matrix(left), ids, matrix(right)):
                same = np.flatnonzero(labels[order] == column(left, "label")[i])[:positives]
                found += [(int(own[i]), x, s) for x, s in zip(ids[order[same]].tolist(), scores[same].tolist())]
        return table(["anchor_id", "positive_id", "positive_score"], found)

    def other_label(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, labels, wanted = column(right, "id"), column(right, "label"), left.column("wanted").to_pylist()
            for i, order, scores in ordered_scores(own := column(left, "id"), matrix(left), ids, matrix(right)):
                other = labels[order] != column(left, "label")[i]
                order, scores = order[other], scores[other]
                for w in wanted[i]:
                    at = in_range(scores, w["positive_score"], k, low, high)
                    found += [(int(own[i]), w["positive_rank"], w["positive_id"], w["positive_score"], x, s) for x, s in zip(ids[order[at]].tolist(), scores[at].tolist())]
        return table(["anchor_id", "positive_rank", "positive_id", "positive_score", "negative_id", "negative_score"], found)

    def met(left: DataFrame, run: object, schema: str) -> DataFrame:
        keys = ("dims", "ab", "cb")
        return dealt(left, "ab", n_a, "cb", n_c).groupBy(*keys).cogroup(dealt(c, "cb", n_c, "ab", n_a).groupBy(*keys)).applyInArrow(run, schema)

    def first(df: DataFrame, groups: list[str], score: str, other: str, rank: str, most: int) -> DataFrame:
        return df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc(score), other))).where(F.col(rank) <= most)

    best = first(met(a, same_label, "anchor_id long, positive_id long, positive_score long"), ["anchor_id"], "positive_score", "positive_id", "positive_rank", positives)
    wanted = best.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_rank", "positive_id", "positive_score")).alias("wanted"))  # at most as many as positives
    near = met(a.join(wanted, "id"), other_label, "anchor_id long, positive_rank long, positive_id long, positive_score long, negative_id long, negative_score long")
    out = first(near, ["anchor_id", "positive_rank"], "negative_score", "negative_id", "rank", k)
    return out.select("anchor_id", F.col("positive_rank").cast("int").alias("positive_rank"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same rows by DuckDB.
SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank
  FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.positive_rank, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_rank ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.positive_rank <= 5 AND s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, CAST(positive_rank AS INTEGER) AS positive_rank, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
