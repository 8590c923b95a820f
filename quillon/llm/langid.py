"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed letter n-grams (n = 1 to 3; other characters are one space between
words). Each language has several centroids from spherical k-means; a text gets the language of the centroid of largest
cosine. A text whose cosine is below the rejection distance is like no learned language: it is marked as rejected. The
distance is learnt for each language: half of a low quantile of the cosines of its distinct sampled texts, each against
centroids without itself. The cosine of a text of fewer than LONG n-grams says little; REJECT is its distance.

The model is fitted on a bounded sample: at most SAMPLE rows in all, shared evenly by the languages and chosen by a hash
of doc_id, each as a sparse vector of its whole text. Prediction covers every whole text; long texts are counted in
pieces of fixed size, so memory is bounded.

Cases: a null text, or one without letters, is ``und`` with score 0 and rejected; with nothing to learn from every text
is ``und``; ties go to the smaller language; repeated rows get equal results; extra columns are kept, but for those
named lang_pred, score and rejected, which are replaced.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import small_batches, text_bytes

#: Labelled rows that the model is fitted on, centroids of a language, hashed dimensions (as bits), characters at a time.
SAMPLE, CENTROIDS, BITS, PIECE = 2400, 4, 16, 1 << 20
#: Cosine below which a short text is like no learned language; the same for others where fewer than ENOUGH texts are learnt.
REJECT = 0.06
#: n-grams from which a text is long, and texts, quantile and share of it that give a language's own rejection distance.
LONG, ENOUGH, QUANTILE, SHARE = 128, 20, 0.01, 0.5
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """The lower-case letter of each code point; 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for point in range(sys.maxunicode + 1):
        if (c := chr(point)).isalpha():
            out[point] = ord(c.lower()[0])
    return out


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text, ascending, and their counts; both empty if it has no letter."""
    total = np.zeros(1 << BITS, np.int64)
    any_letter = False
    for lo in range(0, len(text), PIECE):
        points = np.frombuffer(text[max(0, lo - 2) : lo + PIECE].encode("utf-32-le", "replace"), "<u4")
        c = _letters()[points]
        c = c[(c != 0) | np.append(True, c[:-1] != 0)]  # one space between words
        if not c.any():
            continue
        any_letter = True
        c = np.concatenate(([0], c, [0])).astype(np.uint64)
        mixed = c * np.uint64(0x9E3779B97F4A7C15)
        two = (mixed[:-1] ^ (c[1:] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7))) * np.uint64(0xFF51AFD7ED558CCD)
        three = (two[:-1] ^ (c[2:] * np.uint64(0x165667B19E3779F9) >> np.uint64(5))) * np.uint64(0xC4CEB9FE1A85EC53)
        for h in (mixed[c != 0], two, three):
            total += np.bincount((h >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    at = np.flatnonzero(total) if any_letter else np.zeros(0, np.int64)
    return at, total[at]


def learnable(doc_id: Column) -> Column:
    """Whether a row may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means with farthest-first seeds; rows of x have norm 1."""
    seeds = [0]
    near = x @ x[0]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[seeds[-1]])
    centres = x[seeds]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, 1)
        sums = np.stack([x[own == j].sum(0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def _left_out(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The largest cosine of each row of x with the centroids, its own one made without it."""
    near = x @ centres.T
    own = np.argmax(near, 1)
    for j in range(len(centres)):
        rows = np.flatnonzero(own == j)
        if len(rows):
            whole = x[rows].sum(0)
            along = x[rows] @ whole
            rest = np.sqrt(np.maximum(whole @ whole - 2 * along + 1, 0))  # norm of the sum without the row
            near[rows, j] = np.where(rest > 1e-3, (along - 1) / np.maximum(rest, 1e-3), 0)
    return near.max(1)


def _limit(cosines: np.ndarray) -> float | None:
    """The rejection distance that cosines of known texts give; None if they are too few."""
    return max(REJECT, SHARE * float(np.quantile(cosines, QUANTILE))) if len(cosines) >= ENOUGH else None


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, k: int = CENTROIDS) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language of each centroid, the centroids (one column each), the inverse document frequencies, and the rejection distance of each centroid."""
    small_batches(df.sparkSession)
    known = df.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & learnable(F.col(key)) & F.col(text).rlike(r"\p{L}"))
    counts = {r[0]: r["count"] for r in df.where(F.col(lang).isNotNull() & learnable(F.col(key))).groupBy(lang).count().orderBy(F.desc("count"), lang).limit(sample).collect()}
    none = [], np.zeros((1 << BITS, 0), np.float32), np.ones(1 << BITS, np.float32), np.zeros(0)
    if not counts:
        return none
    each = max(1, sample // len(counts))
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col(lang) == name, F.lit(min(1.0, 1.5 * each / n + 20 / n))).otherwise(share)
    by_hash = F.xxhash64(F.col(key), F.lit(17))
    drawn = known.where(F.pmod(by_hash, F.lit(1 << 30)) < share * (1 << 30))
    place = F.row_number().over(Window.partitionBy(lang).orderBy(by_hash, key))
    chosen = drawn.select(F.col(lang).alias("lang"), F.col(key).alias("key"), text_bytes(df, text).alias("text"), place.alias("place")).where(F.col("place") <= each).select("lang", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [vector(v.as_py().decode("utf-8", "replace")) for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("key"), pa.array([a.astype("<i4").tobytes() for a, _ in pairs], pa.binary()), pa.array([n.astype("<f4").tobytes() for _, n in pairs], pa.binary())], names=["lang", "key", "at", "n"])

    rows = chosen.mapInArrow(run, f"lang string, key {dict(df.dtypes)[key]}, at binary, n binary").collect()  # at most SAMPLE sparse vectors
    rows = sorted(((r.lang, r.key, np.frombuffer(r.at, "<i4"), np.frombuffer(r.n, "<f4")) for r in rows if r.at), key=lambda r: (r[0], r[1]))
    if not rows:
        return none
    seen = np.zeros(1 << BITS)
    for _, _, at, _ in rows:
        seen[at] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    names, centres, known_by = [], [], {}
    for name in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == name]
        used = np.unique(np.concatenate([r[2] for r in own]))  # only columns that the language has are held
        x = np.zeros((len(own), len(used)), np.float32)
        for i, (_, _, at, n) in enumerate(own):
            x[i, np.searchsorted(used, at)] = (1 + np.log(n)) * idf[at]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        got = _kmeans(x, k)
        once = {(at.tobytes(), n.tobytes()): i for i, (_, _, at, n) in enumerate(own) if n.sum() >= LONG}  # copies count once
        distinct = sorted(once.values())
        known_by[name] = _left_out(x[distinct], got) if distinct else np.zeros(0)
        wide = np.zeros((len(got), 1 << BITS), np.float32)
        wide[:, used] = got
        centres.append(wide)
        names += [name] * len(got)
    together = _limit(np.concatenate(list(known_by.values()))) or REJECT
    limits = {name: _limit(cosines) or together for name, cosines in known_by.items()}
    return names, np.ascontiguousarray(np.concatenate(centres).T, np.float32), idf.astype(np.float32), np.array([limits[name] for name in names])


def predict(df: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray, np.ndarray], text: str = "text", reject: float = REJECT) -> DataFrame:
    """df with lang_pred, score (cosine, 0 to 1) and rejected; reject is the distance of short texts."""
    spark = df.sparkSession
    small_batches(spark)
    kept = [c for c in df.columns if c not in ("lang_pred", "score", "rejected")]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    shared = spark.sparkContext.broadcast(model)  # CENTROIDS vectors for each language learnt

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, centres, idf, limits = shared.value
        for batch in batches:
            languages, cosines, bad = [], [], []
            for v in batch.column("__text"):
                at, n = vector(v.as_py().decode("utf-8", "replace"))
                if not len(at) or not names:
                    languages.append(UNKNOWN), cosines.append(0.0), bad.append(True)
                    continue
                x = (1 + np.log(n)) * idf[at]
                near = x @ centres[at] / np.linalg.norm(x)
                best = int(np.argmax(near))
                languages.append(names[best]), cosines.append(float(min(1.0, max(0.0, near[best]))))
                bad.append(bool(cosines[-1] < (limits[best] if n.sum() >= LONG else reject)))
            columns = [*(batch.column(c) for c in kept), pa.array(languages, pa.string()), pa.array(cosines), pa.array(bad, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score", "rejected"])

    return df.select(*kept, text_bytes(df, text).alias("__text")).mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document; learnt from the documents not held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), fit(docs)).select("doc_id", "held_out", "lang_pred", "score", "rejected")
