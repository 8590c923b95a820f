"""Shards by a Feistel permutation with cycle walking over global row numbers.

Rows get the numbers 0 to n - 1 in one global order: doc_id (null first), then three 64-bit hashes, two of the text and
one of all other columns; rows that are equal in all of these are interchangeable. The order comes from one range
shuffle; a partition's numbers start where the partitions before it end, so no task sees more than its partition.

A row number is then permuted by a Feistel network of ROUNDS rounds over the least power of two that is at least n.
A value of n or more is permuted again until one falls below n (cycle walking; under two steps on average), which makes
it a permutation of 0 to n - 1. Place p goes to shard p mod shards, slot p div shards: the shards' counts are at most one
apart (the law ``rows``) and slots have no gaps. place() and row_at() compute both directions from numbers alone, so a
row's shard needs no table, and an order of shards and slots is a reproducible shuffle of the whole input.

Cases: a null text has no bytes; rows with a null doc_id come first in the global order, and any share of equal rows is
spread over partitions and shards like others; fewer rows than shards leave shards empty; an empty table gives no rows;
extra columns are kept, but for those named shard and slot, which are replaced; maps and variants among them do not
count in the order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import written

SHARDS, SEED, ROUNDS = 24, 13, 6
#: Rows of a shard's file at most.
FILE_ROWS = 1 << 20
_MASK = (1 << 64) - 1


def _bits(n: int) -> tuple[int, int]:
    """Bits of the two halves of the domain, the least power of two (4 at least) that holds n values."""
    bits = max(2, (n - 1).bit_length())
    return bits // 2, bits - bits // 2


def _keys(seed: int) -> list[np.uint64]:
    """One key for each round."""
    out, x = [], (seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK
    for _ in range(ROUNDS):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        out.append(np.uint64(x))
    return out


def _scrambled(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = x + key
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _network(x: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The Feistel permutation of the whole domain, or its inverse. ROUNDS is even, so the halves end as wide as they began."""
    a, b = _bits(n)
    left, right = x >> np.uint64(b), x & np.uint64((1 << b) - 1)
    rounds = list(enumerate(_keys(seed)))
    for i, key in reversed(rounds) if back else rounds:
        # in even rounds the left half has a bits, in odd ones b; what a round takes from the right half keeps that width
        mask = np.uint64((1 << (a if i % 2 == 0 else b)) - 1)
        if back:
            left, right = right ^ (_scrambled(left, key) & mask), left
        else:
            left, right = right, left ^ (_scrambled(right, key) & mask)
    return left << np.uint64(b) | right


def permuted(rows: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """Where the permutation of 0 to n - 1 puts each row number, or with back which row number it puts at each place."""
    x = np.asarray(rows, np.uint64).copy()
    if len(x) and int(x.max()) >= n:
        raise ValueError(f"row numbers end at {n - 1}")
    walking = np.arange(len(x))
    while len(walking):
        x[walking] = _network(x[walking], n, seed, back)
        walking = walking[x[walking] >= np.uint64(n)]
    return x.astype(np.int64)


def place(row: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = int(permuted(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number at a shard and slot."""
    return int(permuted(np.array([slot * shards + shard]), n, seed, back=True)[0])


def numbered(docs: DataFrame, text: str = "text", key: str = "doc_id", name: str = "row_no") -> tuple[DataFrame, int]:
    """docs with every row's number in the global order, and the number of rows."""
    plain = [c for c, kind in docs.dtypes if c not in (text, key) and "map<" not in kind and "variant" not in kind]
    held = docs.select(F.struct(*docs.columns).alias("r"))  # apart from columns of clashing names
    t, rest = F.col(f"r.`{text}`"), [x for c in plain for x in (F.col(f"r.`{c}`"), F.col(f"r.`{c}`").isNull())]
    order = {"k": F.col(f"r.`{key}`"), "x": F.xxhash64(t, t.isNull()), "y": F.xxhash64(F.lit(1), t, t.isNull()), "z": F.xxhash64(F.lit(2), *rest), "any": F.monotonically_increasing_id()}
    # the last column splits rows that are equal in all others over partitions
    by = [F.asc_nulls_first("k"), "x", "y", "z", "any"]
    ordered = held.withColumns(order).repartitionByRange(*by).sortWithinPartitions(*by).select("r", F.monotonically_increasing_id().alias("at"))
    ordered = written(ordered, "shard-rows")  # the ranges are sampled: written, numbers and counts are of the same ones
    part = F.shiftright("at", 33)
    first, offsets = 0, []
    for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each partition
        offsets.append((r.part, first))
        first += r.n
    starts = docs.sparkSession.createDataFrame(offsets, "part long, first long")
    joined = ordered.withColumn("part", part).join(F.broadcast(starts), "part")
    return joined.select(*(F.col(f"r.`{c}`").alias(c) for c in docs.columns if c != name), (F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name)), first


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with shard and slot of every row."""
    kept = docs.select(*(f"`{c}`" for c in docs.columns if c not in ("shard", "slot")))
    rows, n = numbered(kept, text, key, "__row_no")

    @F.pandas_udf("long")
    def placed(numbers: pd.Series) -> pd.Series:
        return pd.Series(permuted(numbers.to_numpy(), n, seed))

    at = rows.withColumn("__place", placed("__row_no"))
    return at.select(*kept.columns, F.pmod("__place", F.lit(shards)).cast("int").alias("shard"), F.expr(f"__place div {shards}").alias("slot"))


def write_shards(rows: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Write the rows of sharded() as shard=<shard>/file=<number>/, each file's rows by slot; a file holds file_rows slots, so no task holds a whole shard."""
    files = rows.withColumn("file", F.expr(f"slot div {file_rows}"))
    files.repartition("shard", "file").sortWithinPartitions("shard", "file", "slot").write.partitionBy("shard", "file").parquet(path)
