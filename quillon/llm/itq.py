"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learnt so that the signs of a rotated vector are a balanced binary code of up to 64
bits (on a bounded sample: FIT vectors chosen by hash). The code's four parts of 16 bits are the keys of four tables.
Every vector is entered under its own part and looked up under its own part with every subset of its WEAK least certain
bits (those nearest to zero) flipped. A pair that meets in several tables, or from both sides, is counted where it meets
first, which both codes tell. Pairs that meet are ranked again by the cosine of the original vectors in double precision.

Equal vectors of a label are one entry with a number of copies, so they are never compared with each other. Buckets are
cut into blocks of at most BLOCK rows on either side; the links of a block are counted, and its components reduced to
one edge for each vector, before anything leaves the task.

Cases: rows whose label is null, or whose vector is null, empty, zero or holds null or non-finite components, link with
nothing and are kept; vectors of different lengths do not link; repeated rows count as copies; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import written
from quillon.llm.components import components

FIT, ROUNDS, TABLES, PART, WEAK, BLOCK, PAIRS = 8192, 40, 4, 16, 3, 4096, 1 << 18


def fit_rotation(x: np.ndarray, bits: int = 64, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (one column a bit); x has a row for each vector, of norm 1."""
    mean = x.mean(0)
    _, axes = np.linalg.eigh((x - mean).T @ (x - mean))
    axes = axes[:, ::-1][:, :bits]
    v = (x - mean) @ axes
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(v.T @ np.where(v @ r > 0, 1.0, -1.0))
        r = u @ w
    return mean, axes @ r


def encode(x: np.ndarray, mean: np.ndarray, projection: np.ndarray, weak: int = WEAK) -> tuple[np.ndarray, np.ndarray]:
    """Codes and masks of the least certain bits of each part, as unsigned 64-bit; x has norm 1."""
    v = np.zeros((len(x), TABLES * PART))
    v[:, : projection.shape[1]] = (x - mean) @ projection
    v[:, projection.shape[1] :] = -np.inf  # unused bits are 0 and certain
    bit = np.uint64(1) << np.arange(TABLES * PART, dtype=np.uint64)
    code = ((v > 0) * bit).sum(1, dtype=np.uint64)
    least = np.argsort(np.abs(v).reshape(len(x), TABLES, PART), 2, kind="stable")[:, :, :weak] + (np.arange(TABLES) * PART)[None, :, None]
    return code, bit[least].sum((1, 2), dtype=np.uint64)


def _dense(rows: pa.Array, width: int) -> np.ndarray:
    """A row for each list, filled up with zeros."""
    out = np.zeros((len(rows), width))
    lengths = np.asarray(pc.list_value_length(rows)) if len(rows) else np.zeros(0, int)
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out[np.repeat(np.arange(len(rows)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of norm 1, in double precision; the largest component is divided out first, so nothing overflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reached from each of n by the pairs (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(least: float, width: int, kind: str) -> object:
    """The task that compares the blocks of its partition, whose rows are sorted by block."""

    def flush(t: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        unit = _unit(np.frombuffer(b"".join(t["v"]), kind).reshape(-1, width))
        probe = np.flatnonzero(t["side"] == 0)
        first = np.r_[True, (t["key"][1:] != t["key"][:-1]) | (t["block"][1:] != t["block"][:-1])]
        group = np.cumsum(first) - 1
        entry = np.flatnonzero(t["side"] == 1)
        lo, hi = np.searchsorted(group[entry], group[probe]), np.searchsorted(group[entry], group[probe], "right")
        ids, back = np.unique(t["id"], return_inverse=True)
        degree, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        at = 0
        count = hi - lo
        while at < len(probe):
            end = max(at + 1, int(np.searchsorted(np.cumsum(count[at:]), PAIRS, "right")) + at)
            n = count[at:end]
            p = np.repeat(probe[at:end], n)
            i = entry[np.repeat(lo[at:end], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            at = end
            keep = t["id"][p] != t["id"][i]
            p, i = p[keep], i[keep]
            d, wp, wi, table = t["code"][p] ^ t["code"][i], ~t["weak"][p], ~t["weak"][i], t["table"][p]
            seen = np.zeros(len(p), bool)  # whether the pair has met before
            for k in range(TABLES):
                part = np.uint64(((1 << PART) - 1) << (k * PART))
                from_p, from_i = (d & part & wp) == 0, (d & part & wi) == 0
                seen |= (k < table) & (from_p | from_i) | (k == table) & from_i & (t["id"][i] < t["id"][p])
            p, i = p[~seen], i[~seen]
            near = np.einsum("ij,ij->i", unit[p], unit[i]) >= least
            p, i = p[near], i[near]
            np.add.at(degree, back[p], t["copies"][i])
            np.add.at(degree, back[i], t["copies"][p])
            if len(p):
                joined = local_components(len(ids), np.concatenate((back[p], np.arange(len(ids)))), np.concatenate((back[i], label)))
                label = joined
        found = np.flatnonzero((degree > 0) | (label != np.arange(len(ids))))
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(degree[found]), pa.array(ids[label[found]])], names=["id", "links", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        rows = 0
        for batch in batches:
            t = {n: (np.array(c.to_pylist(), object) if n == "v" else c.to_numpy(zero_copy_only=False)) for n, c in zip(batch.schema.names, batch.columns)}
            t["code"], t["weak"] = t["code"].view(np.uint64), t["weak"].view(np.uint64)
            held.append(t)
            rows += batch.num_rows
            if rows < 20_000:
                continue
            whole = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
            last = np.flatnonzero((whole["key"] != whole["key"][-1]) | (whole["block"] != whole["block"][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from flush({n: c[:cut] for n, c in whole.items()})
            held, rows = [{n: c[cut:] for n, c in whole.items()}], len(whole["key"]) - cut
        if rows:
            whole = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
            yield from flush(whole)

    return run


def links(vectors: DataFrame, least: float = 0.93) -> tuple[DataFrame, DataFrame]:
    """(vec_id, copy_of and copies of every vector that can link; id, links and to of every partial count and edge)."""
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    valid = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fit)
    keyed = valid.select("vec_id", "label", "embedding", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"))
    groups = written(keyed.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")), "itq-vectors")
    members = keyed.select("vec_id", "label", "k1", "k2").join(groups.select("label", "k1", "k2", F.col("id").alias("copy_of"), "copies"), ["label", "k1", "k2"]).select("vec_id", "copy_of", "copies")
    width = groups.agg(F.max(F.size("embedding"))).first()[0] or 1
    sample = groups.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(FIT).toArrow()
    if not sample.num_rows:
        return members, vectors.sparkSession.createDataFrame([], "id long, links long, to long")
    mean, projection = fit_rotation(_unit(_dense(sample.column("embedding").combine_chunks(), width)), TABLES * PART)
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _dense(batch.column("embedding"), width)
            code, weak = encode(_unit(x), mean, projection)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copies"), batch.column("space"), pa.array(code.view(np.int64)), pa.array(weak.view(np.int64)), pa.array([r.astype(kind).tobytes() for r in x], pa.binary())], names=["id", "copies", "space", "code", "weak", "v"])

    space = F.xxhash64("label", F.size("embedding"))
    table = written(groups.select("id", "copies", space.alias("space"), "embedding").mapInArrow(coded, "id long, copies long, space long, code long, weak long, v binary"), "itq-codes")

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id, side, table and bucket of every entry (side 1) and look-up (side 0)."""
        for batch in batches:
            ids, space, code, weak = (batch.column(n).to_numpy() for n in ("id", "space", "code", "weak"))
            space, code, weak, out = space.view(np.uint64), code.view(np.uint64), weak.view(np.uint64), []
            for k in range(TABLES):
                part = code >> np.uint64(k * PART) & np.uint64((1 << PART) - 1)
                mask = weak >> np.uint64(k * PART) & np.uint64((1 << PART) - 1)
                probes = part[:, None]
                for _ in range(WEAK):
                    bit = mask & (~mask + np.uint64(1))
                    mask = mask ^ bit
                    probes = np.concatenate((probes, probes ^ bit[:, None]), 1)
                for side, parts in ((1, part[:, None]), (0, probes)):
                    key = space[:, None] ^ ((parts | np.uint64(k << PART)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                    out.append((np.repeat(ids, parts.shape[1]), np.full(parts.size, side, np.int32), np.full(parts.size, k, np.int32), key.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["id", "side", "table", "key"])

    entries = table.select("id", "space", "code", "weak").mapInArrow(looked_up, "id long, side int, table int, key long")
    sizes = entries.groupBy("key").agg(F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 0).alias("n0")).where("n1 > 0 AND n0 > 1")
    placed = entries.join(sizes, "key").withColumns({"s1": F.ceil(F.col("n1") / BLOCK), "s0": F.ceil(F.col("n0") / BLOCK)})
    own = F.pmod(F.xxhash64("id", F.lit(3)), F.when(F.col("side") == 1, F.col("s1")).otherwise(F.col("s0")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("side") == 1, F.col("s0")).otherwise(F.col("s1")) - 1))
    placed = placed.withColumn("own", own).withColumn("other", other)
    block = F.when(F.col("side") == 1, F.col("own") * (1 << 31) + F.col("other")).otherwise(F.col("other") * (1 << 31) + F.col("own"))
    placed = placed.select("key", block.alias("block"), "side", "table", "id").join(table.drop("space"), "id")
    found = placed.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(_linked(least, width, kind), "id long, links long, to long")
    return members, written(found, "itq-links")


def near_duplicates(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    members, found = links(vectors, least)
    degree = found.groupBy("id").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    info = members.join(degree, F.col("copy_of") == F.col("id"), "left").drop("id").join(label, F.col("copy_of") == F.col("id"), "left")
    info = info.select("vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "copy_of").alias("component_id")).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select("vec_id").join(info, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


#: The same rows by DuckDB, by comparing all pairs.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, m.c AS component_id, m.c = e.vec_id AS kept
FROM embeddings e JOIN m ON m.id = e.vec_id
"""
