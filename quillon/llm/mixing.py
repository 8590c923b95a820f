"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted the same number of times, its source's target over its source's size. The whole
part of that number is taken at once; the fractional parts are rounded together: two documents exchange expected words
at random until one of their fractions is 0 or 1, so the words expected of the pair do not change; the other goes on
to the next. Each bucket of a source leaves at most one fraction open; these residuals are paired in the same way, 256
buckets at a time, up a tree, until one fraction of the source is left, which is rounded by itself. A source therefore
misses its target by less than one document. Rows of equal source, doc_id and size are counted, and every CHUNK of them
is a unit; buckets are set by a hash of the unit and their number by the source's rows, so no task holds more than about
BUCKET rows of any source, whatever the ids; all randomness is hashed from the source, the bucket and a seed, so reruns
agree.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating, and share the words of all documents; a
target stops at 3 times its source's words, and the excess is shared again by weight until none is above.

Cases: a null or empty text has size 0 and is taken 0 times; repeated rows, and rows without a doc_id, are rounded one by
one; a source without words has target 0; an empty table gives no rows; extra columns are kept by mixed().
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import with_possible, written

WEIGHTS, MOST, BUCKET, FAN, CHUNK = (5.0, 2.0, 1.0), 3.0, 8192, 256, 256
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with place: 0, 1, ... by code point, null last. Ranges are numbered apart and moved by the counts before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int64()), pa.array(range(n, n + batch.num_rows), pa.int64())], names=[*batch.schema.names, "part", "local"])
            n += batch.num_rows

    order = [F.col("source").isNull(), F.col("source")]
    local = written(sources.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "source string, n long, source_size long, part long, local long"), "sources")
    counts = {r.part: r["count"] for r in local.groupBy("part").count().collect()}
    before, total = F.lit(0), 0
    for part in sorted(counts):
        before = F.when(F.col("part") == part, F.lit(total)).otherwise(before)
        total += counts[part]
    return local.select("source", "n", "source_size", (F.col("local") + before).alias("place"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, n, source_size and target of every source; sizes has source and size of every document."""
    sources = _numbered(sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights)).cast("int") + 1)
    each = sources.select("source", "n", "source_size", weight.alias("weight"))
    capped = lambda rate: rate * F.col("weight") >= most * F.col("source_size")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    rate, held = 0.0, -1
    while True:  # words for a unit of weight; ends when no more sources are held at their limit
        limit = capped(F.lit(rate)) if held >= 0 else F.lit(False)
        r = each.agg(F.sum(F.when(limit, most * F.col("source_size")).otherwise(0.0)).alias("fixed"), F.sum(F.when(limit, 0.0).otherwise(F.col("weight"))).alias("free"), F.sum(F.when(limit, 1).otherwise(0)).alias("held")).first()
        if r.held == held or not r.free:
            break
        held, rate = r.held, (total - r.fixed) / r.free
    return each.select("source", "n", "source_size", F.least(F.lit(rate) * F.col("weight"), most * F.col("source_size")).cast("double").alias("target"))


def pivot(size: np.ndarray, p: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Round all fractions but one at most; the fractions, 0 or 1 but for that one, and its index (or -1).

    Each step keeps the expected words of the pair and, at random, fills one or empties the other.
    """
    p, at = p.tolist(), -1
    size, draws = size.tolist(), draws.tolist()
    for i in range(len(p)):
        if p[i] <= 0 or p[i] >= 1:
            continue
        if at < 0:
            at = i
            continue
        a, b, sa, sb = p[at], p[i], size[at], size[i]
        up, down = min((1 - a) * sa, b * sb), min(a * sa, (1 - b) * sb)
        if draws[i] * (up + down) < down:  # words go from i to the open one
            if (1 - a) * sa <= b * sb:
                p[at], p[i] = 1.0, b - up / sb
            else:
                p[at], p[i] = a + up / sa, 0.0
        elif a * sa <= (1 - b) * sb:
            p[at], p[i] = 0.0, b + down / sb
        else:
            p[at], p[i] = a - down / sa, 1.0
        if not 1e-12 < p[at] < 1 - 1e-12:
            p[at] = float(round(p[at]))
            at = i if 1e-12 < p[i] < 1 - 1e-12 else -1
        if not 1e-12 < p[i] < 1 - 1e-12:
            p[i] = float(round(p[i]))
    return np.array(p, float), at


def settle(size: np.ndarray, p: np.ndarray, p0: np.ndarray, at: int, draws: np.ndarray) -> int:
    """Hand the residual at index at on to a small document; the index of the new residual.

    A large document left over would miss the target by up to its size. It is rounded (up with its probability), and
    documents already rounded, in random order, give the same words back, each wholly but the last, the smallest that
    is large enough, which stays open. Expected copies do not change, as what is given back has mean 0. p is changed.
    """
    up = draws[at] < p[at]
    words = (1 - p[at]) * size[at] if up else p[at] * size[at]
    pool = np.flatnonzero((p0 > 0) & (p0 < 1) & (p == (1.0 if up else 0.0)) & (size < size[at]))
    last = pool[np.lexsort((pool, size[pool]))]
    changed = []
    for i in pool[np.argsort(draws[pool], kind="stable")].tolist():
        if size[i] <= words:
            changed.append(i)
            words -= size[i]
    given = np.zeros(len(size), bool)
    given[changed] = True
    rest = [i for i in last.tolist() if size[i] > words and not given[i]][:1]
    if words > 0 and not rest:
        return at
    p[changed] = 0.0 if up else 1.0
    p[at] = 1.0 if up else 0.0
    if words <= 0:
        return -1
    p[rest[0]] = 1 - words / size[rest[0]] if up else words / size[rest[0]]
    return rest[0]


def _rounded(df: DataFrame, key: str, seed: int, level: int, order: list[str], last: bool, schema: str) -> DataFrame:
    """df with p rounded in each group of source and key; is_open marks the residual of a group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        if "times" in group:  # rows that are equal but for their number
            group = group.loc[group.index.repeat(group["times"])].drop(columns="times").reset_index(drop=True)
        group = group.sort_values(["size", *order], ascending=[False, *[True] * len(order)], kind="stable")  # the residual tends to be a small document
        name = f"{seed}|{level}|{group['source'].iloc[0]!r}|{group[key].iloc[0]}"
        draws = np.random.default_rng([zlib.crc32(name.encode()), zlib.adler32(name.encode()), seed]).random(len(group) + 1)
        size, p0 = group["size"].to_numpy(float), group["p"].to_numpy(float)
        p, at = pivot(size, p0, draws[:-1])
        if at >= 0:
            at = settle(size, p, p0, at, draws[::-1])
        if at >= 0 and last:
            p[at], at = float(draws[-1] < p[at]), -1
        return group.assign(p=p, is_open=np.arange(len(group)) == at)

    return df.groupBy("source", key).applyInPandas(run, schema)


def mix(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken of every row of df."""
    sized = written(df.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size")), "sizes")
    by_source = written(targets(sized, weights, most), "targets")
    units = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / CHUNK))))
    units = units.withColumn("times", F.least(F.col("rows") - F.col("chunk") * CHUNK, F.lit(CHUNK)).cast("long"))
    wanted = units.alias("d").join(by_source.alias("s"), F.expr("d.source <=> s.source")).select("d.doc_id", "d.source", "d.size", "d.chunk", "d.times", "s.source_size", "s.target", "s.n")
    wanted = wanted.withColumn("copies", F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    kind = dict(sized.dtypes)["doc_id"]
    has_id, some_id = F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0).cast(kind))  # pandas would make floats of numbers among nulls
    wanted = wanted.select(some_id.alias("doc_id"), has_id.alias("has_id"), "source", "size", "source_size", "target", F.floor("copies").alias("whole"), (F.col("copies") - F.floor("copies")).alias("p"), F.pmod(F.xxhash64("doc_id", "size", "chunk", F.lit(seed)), F.ceil(F.col("n") / BUCKET)).alias("bucket"), "times")
    columns = f"doc_id {kind}, has_id boolean, source string, size long, source_size long, target double, whole long, p double, bucket long, is_open boolean"
    first = written(_rounded(wanted, "bucket", seed, 0, ["has_id", "doc_id"], False, columns), "rounded")
    done, buckets = None, -(-(by_source.agg(F.max("n")).first()[0] or 0) // BUCKET)
    left, level = first.where("is_open").select("source", "bucket", "size", "p", F.col("bucket").alias("group")), 0
    while left is not None:
        level += 1
        buckets = -(-buckets // FAN)
        last = buckets <= 1
        here = written(_rounded(left.withColumn("group", F.floor(F.col("group") / FAN)), "group", seed, level, ["bucket"], last, "source string, bucket long, size long, p double, group long, is_open boolean"), f"residuals-{level}")
        part = here.where("NOT is_open").select("source", "bucket", F.col("p").alias("up"))
        done = part if done is None else done.unionByName(part)
        left = None if last else here.where("is_open").drop("is_open")
    settled = first.where("NOT is_open").withColumn("up", F.col("p"))
    opened = first.where("is_open").alias("f").join(done.alias("r"), F.expr("f.source <=> r.source AND f.bucket = r.bucket")).select("f.*", "r.up")
    copies = F.col("whole") + F.col("up").cast("long")
    return settled.unionByName(opened).select(F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", **more: object) -> DataFrame:
    """The mix itself: every row of docs as often as mix() takes it. Rows that are equal in all columns are one row taken as often as all of them."""
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]  # other columns cannot be hashed
    parts = [*plain, *(F.col(c).isNull() for c in plain)]  # a hash passes nulls over
    name = F.concat_ws("-", F.xxhash64(*parts).cast("string"), F.xxhash64(F.lit(1), *parts).cast("string"))
    named = docs.withColumn("__name", name)
    taken = mix(named.select("__name", F.col(text).alias("__text"), F.col(source).alias("__source")), "__text", "__source", "__name", **more)
    taken = written(taken.groupBy(F.col("doc_id").alias("__name")).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")), "copies")
    if (taken.agg(F.max("__rows")).first()[0] or 0) > 1:  # equal rows, which a filter of their names singles out
        flagged = with_possible(named, "__name", written(taken.where("__rows > 1").select("__name"), "repeated"), "__again")
        named = flagged.where("NOT __again").unionByName(flagged.where("__again").dropDuplicates(["__name"])).drop("__again")
    joined = named.join(taken.where("__copies > 0").drop("__rows"), "__name").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return joined.select(*docs.columns)
