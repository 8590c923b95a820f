"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Which strings of LENGTH bytes occur twice is decided on blocks of text. A block's suffixes are sorted by their first
LENGTH bytes, which gives its Burrows-Wheeler transform. From the empty string on, all intervals of one string length are
extended backward by one byte at a time (breadth first); an interval whose right end has no value yet sets the common
prefix there to the current length and is extended further. So common prefixes are found by increasing value. The
expansion stops at LENGTH: places without a value then are neighbours with at least LENGTH bytes in common.

What may be equal has to meet in a block. Every string of LENGTH bytes has an anchor, its K-byte string of least hash (the
leftmost of equals), so equal strings have equal anchors. Consecutive strings with the same anchor are one stretch of
text. Stretches meet by their anchor's hash; anchors that occur once are dropped; equal stretches (by two 64-bit
hashes) are one entry with a number of copies. An anchor whose entries are too many for a block (HOT bytes) is split
further: its strings meet by a 128-bit hash of all their bytes, counted with partial sums, so no group is ever too large;
their starts are joined to runs RUN starts at a time.

Passages are found in the same run and by the same method, with words (between ASCII white space) for bytes, PASSAGE for
LENGTH and PASSAGE_K for K: a run of words that strings of PASSAGE words cover which also stand in another document.
They are counted beside the removed bytes, as most passages of that many words are shorter than LENGTH bytes. What a
text repeats only within itself is no passage; rows of equal doc_id and text are one document here. A row is named by
two 64-bit hashes of its doc_id and text, so rows without a doc_id, or of one doc_id, keep apart.

Cases: a null text is empty; texts shorter than LENGTH lose nothing; a text of a repeated row is a repeated string;
matches never cross documents; a byte-wise cut may leave text that is no valid UTF-8, so results are bytes or digests,
and the column text has a replacement character there; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import drop_written, small_batches, text_bytes, written

LENGTH, K = 400, 100
PASSAGE, PASSAGE_K = 50, 16
#: Bytes that a block aims at, of an anchor's entries before they are split, of a text that is hashed at once.
BLOCK, HOT, PIECE = 1 << 20, 4 << 20, 1 << 22
#: Starts that are joined to runs at once; blocks for each core at most.
RUN, WAVES = 4096, 64
SPACE = re.compile(rb"[\x20\x09-\x0D]")
_B, _G = np.uint64(0x5851F42D4C957F2D), 0x9E3779B97F4A7C15
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse."""
    base = (int(_B) + 8 * seed) | 1
    if seed not in _TABLES or len(_TABLES[seed][0]) < n:
        size = max(n, 1 << 17)
        ones = lambda b: np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))))
        _TABLES[seed] = ones(base), ones(pow(base, -1, 1 << 64))
    p, q = _TABLES[seed]
    return p[:n], q[:n]


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_G))


def rolling(values: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every k consecutive units, given by a 64-bit value each."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64)
    p, q = _powers(n + 1, seed)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * p[:n], out=total[1:])
    return _mix((total[k:] - total[:-k]) * q[: n - k + 1])


def _words_at(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word."""
    flat = np.frombuffer(raw, np.uint8)
    space = np.ones(len(flat) + 2, bool)
    space[1:-1] = (flat == 32) | (flat >= 9) & (flat <= 13)
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    # a word's bytes by powers of a multiplier, from the sums before and behind it; the hash depends on the word alone
    p, q = _powers(len(flat) + 1, 0)
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTES[flat] * p[: len(flat)], out=total[1:])
    return _mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64) * np.uint64(_G)), starts, ends


def words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of a text of any length."""
    out, lo = [], 0
    while not out or lo < len(text):
        hi = lo + PIECE
        if hi < len(text):  # a piece ends at white space
            found = SPACE.search(text, hi)
            hi = found.start() if found else len(text)
        h, a, b = _words_at(text[lo:hi])
        out.append((h, a + lo, b + lo))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out))


def stretches(units: bytes | np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors' hashes, first starts and last starts of the stretches of equal anchor over all starts of length units (bytes, or words' hashes)."""
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
    w = length - k + 1
    for lo in range(0, max(0, len(units) - length + 1), PIECE):
        part = units[lo : lo + PIECE + length - 1]
        h = rolling(_BYTES[np.frombuffer(part, np.uint8)] if isinstance(part, bytes) else part, k)
        v = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equals has the least place
        n = len(h) - w + 1
        rows = np.full(-(-len(v) // w) * w, ~np.uint64(0))
        rows[: len(v)] = v
        rows = rows.reshape(-1, w)
        right = np.minimum.accumulate(rows, 1).ravel()
        left = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        at = (np.minimum(left[:n], right[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.append(first[1:], n) - 1
        out.append((h[at[first]].view(np.int64), first + lo, last + lo))
    return tuple(np.concatenate(x) for x in zip(*out))


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by their first depth symbols; 0 is a separator, and separators differ by place.

    Suffixes that are equal that far come in any order.
    """
    n, bits = len(symbols), max(9, int(symbols.max()).bit_length())
    h = 63 // bits  # symbols that the first key holds
    padded = np.concatenate((symbols.astype(np.uint64), np.zeros(h, np.uint64)))
    key = np.zeros(n, np.uint64)
    for j in range(h):
        key = key << np.uint64(bits) | padded[j : j + n]
    separators, short = np.flatnonzero(symbols == 0), np.zeros(n, bool)
    for j in range(h):  # what follows a separator does not count
        at = separators[separators >= j] - j
        at = at[~short[at]]
        short[at] = True
        key[at] &= ~((np.uint64(1) << np.uint64(bits * (h - j))) - np.uint64(1))
    order = np.argsort(key)
    key, short = key[order], short[order]
    alone = np.flatnonzero(short)
    order[alone] = order[alone][np.lexsort((order[alone], key[alone]))]
    new = np.r_[True, (key[1:] != key[:-1]) | short[1:] | short[:-1]]
    rank = np.empty(n, np.int32)  # half the memory that is looked up at random
    heads = np.flatnonzero(new)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    where = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in a group of several
    three = n + 1 < 1 << 21  # three ranks fit one key
    while len(where) and h < depth:
        i = order[where]
        pair = rank[i].astype(np.int64)
        for step in (h, 2 * h)[: 2 if three else 1]:
            pair *= n + 1
            pair += rank[np.minimum(i + step, n - 1)]
        by = np.argsort(pair)
        i, pair = i[by], pair[by]
        order[where] = i
        new = np.r_[True, pair[1:] != pair[:-1]]
        heads = np.flatnonzero(new)
        rank[i] = np.repeat(where[heads], np.diff(np.append(heads, len(where))))
        where = where[~(new & np.append(new[1:], True))]
        h *= 3 if three else 2
    return order


def repeated_places(symbols: np.ndarray, length: int, owner: np.ndarray | None = None) -> np.ndarray:
    """For each place whether the length symbols from there on (no separator, 0, among them) start at another place too.

    symbols ends with a separator. With owner (a number for each place), whether they also start at a place of another one.
    """
    n, sigma = len(symbols), int(symbols.max()) + 1
    order = suffix_order(symbols, length + 1)
    before = symbols[order - 1].astype(np.uint16 if sigma <= 1 << 16 else np.int64)
    before[order == 0] = 0
    lf = np.empty(n, np.int64)
    lf[np.argsort(before, kind="stable")] = np.arange(n)
    lf[before == 0] = -1  # nothing goes on before a separator
    first = symbols[order].astype(before.dtype)  # ascends
    shift = n.bit_length()
    known = np.zeros(n + 1, bool)  # whether the common prefix with the suffix before is found yet
    counts = np.bincount(symbols, minlength=sigma)
    ends, m = np.cumsum(counts), int(counts[0])
    known[: m + 1] = known[n] = True
    # strings of one symbol; each separator is a string of its own
    starts_1, ends_1 = ends[:-1][counts[1:] > 0], ends[1:][counts[1:] > 0]
    known[ends_1] = True
    lo, hi = np.concatenate((np.arange(m), starts_1)), np.concatenate((np.arange(m) + 1, ends_1))
    for _ in range(1, length):
        if not len(lo):
            break
        width = hi - lo
        total = np.cumsum(width)
        at = np.arange(total[-1]) + np.repeat(lo - (total - width), width)
        # where each place goes, with its interval; the places of one symbol keep their order, so sorting gives new intervals
        key = np.sort(lf[at] << shift | np.repeat(np.arange(len(lo)), width))
        key = key[np.searchsorted(key, 0) :]
        if not len(key):
            break
        place, group = key >> shift, key & ((1 << shift) - 1)
        edge = np.flatnonzero((group[1:] != group[:-1]) | (first[place[1:]] != first[place[:-1]]))
        new_lo, new_hi = place[np.append(0, edge + 1)], place[np.append(edge, len(place) - 1)] + 1
        fresh = ~known[new_hi]
        lo, hi = new_lo[fresh], new_hi[fresh]
        known[hi] = True
    long = ~known[:n]  # with the suffix before it in order
    out = np.zeros(n, bool)
    if owner is None:
        out[order] = long | np.append(long[1:], False)
    else:
        heads = np.flatnonzero(~long)  # of groups that have length symbols in common
        several = np.minimum.reduceat(owner[order], heads) != np.maximum.reduceat(owner[order], heads)
        out[order] = np.repeat(several, np.diff(np.append(heads, n)))
    return out


def repeated_in(entries: list[bytes] | list[np.ndarray], length: int = LENGTH, owners: list[int] | None = None) -> list[np.ndarray]:
    """For each entry (bytes, or words' hashes) the starts whose length units also start elsewhere in the entries, or in those of another owner."""
    sizes = np.array([len(e) for e in entries])
    ends = np.cumsum(sizes + 1)
    symbols = np.zeros(int(ends[-1]), np.int64)
    inside = np.ones(len(symbols), bool)
    inside[ends - 1] = False
    if isinstance(entries[0], bytes):
        symbols[inside] = np.frombuffer(b"".join(entries), np.uint8).astype(np.int64) + 1
    else:
        symbols[inside] = np.unique(np.concatenate(entries), return_inverse=True)[1] + 1
    found = repeated_places(symbols, length, None if owners is None else np.repeat(np.array(owners), sizes + 1))
    return [np.flatnonzero(found[b - len(e) - 1 : b - 1]) for e, b in zip(entries, ends.tolist())]


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Spans covered by strings of length bytes at the ascending starts; consecutive starts are one span."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist()))


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """doc and mark (two 64-bit hashes of doc_id and text, which together name a row, or equal rows) and text."""
    raw, none = text_bytes(docs, text), F.col("doc_id").isNull()
    return docs.select("doc_id", F.xxhash64("doc_id", none, raw).alias("doc"), F.xxhash64(F.lit(1), "doc_id", none, raw).alias("mark"), raw.alias("text"))


def spans(docs: DataFrame, text: str = "text", length: int = LENGTH, k: int = K, passage: int = PASSAGE, passage_k: int = PASSAGE_K, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """doc, mark, unit (0 bytes, 1 words), start and end of spans that repeated strings cover; spans of a row may overlap."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    keyed = _keyed(docs, text)
    lengths = length, passage
    # an anchor's lowest bit is its unit
    unit = F.col("anchor").bitwiseAND(F.lit(1)).cast("int")
    whole = F.when(unit == 0, length).otherwise(passage)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, mark, raw in zip(*(c.to_pylist() for c in batch.columns)):
                hashes = words(raw)[0]
                for u, units, part in ((0, raw, k), (1, hashes, passage_k)):
                    found, lo, hi = stretches(units, lengths[u], part)
                    content = memoryview(raw if u == 0 else hashes.tobytes())
                    step = 1 if u == 0 else 8
                    digests = np.array([xxhash.xxh3_64_intdigest(content[a:b]) for a, b in zip((lo * step).tolist(), ((hi + lengths[u]) * step).tolist())], np.uint64)
                    for c, v in zip(columns, ((found & ~1) | u, digests.view(np.int64), np.full(len(lo), doc), np.full(len(lo), mark), lo.astype(np.int32), hi.astype(np.int32))):
                        c.append(v)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["anchor", "digest", "doc", "mark", "lo", "hi"])

    every = written(keyed.where(F.length("text") >= min(length, 2 * passage - 1)).select("doc", "mark", "text").mapInArrow(anchors, "anchor long, digest long, doc long, mark long, lo int, hi int"), "anchors")
    # a table of its own, so that the join below can split the partition of a very common anchor
    first, last, in_bytes = F.min(F.struct("doc", "mark")), F.max(F.struct("doc", "mark")), unit == 0  # bytes may repeat within a document
    again = every.groupBy("anchor").agg(F.count("*").alias("n"), F.min("digest").alias("x"), F.max("digest").alias("y"), (first < last).alias("apart"))
    again = written(again.where((F.col("n") > 1) & (in_bytes | F.col("apart"))).select("anchor", (F.col("x") < F.col("y")).alias("mixed")), "repeated-anchors")
    repeated = written(every.join(again, "anchor"), "repeated")
    drop_written(every)
    span = lambda df: df.select("doc", "mark", unit.alias("unit"), F.col("lo").alias("start"), (F.col("hi") + whole).alias("end"))
    covered = span(repeated.where("NOT mixed"))
    # anchors with different stretches: copies of one are repeated; one of each goes to a block
    mixed = repeated.where("mixed")
    grouped = mixed.groupBy("anchor", "digest").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "mark", "lo", "hi")).alias("r"), (first < last).alias("apart"))
    grouped = written(grouped.withColumn("whole", (F.col("copies") > 1) & (in_bytes | F.col("apart"))), "stretches")
    copied = span(mixed.join(grouped.where("whole").select("anchor", "digest"), ["anchor", "digest"], "left_semi"))
    # of words that one document repeats each copy is an entry
    own = mixed.join(grouped.where("copies > 1 AND NOT whole").select("anchor", "digest"), ["anchor", "digest"], "left_semi").select("anchor", F.lit(1).cast("long").alias("copies"), "doc", "mark", "lo", "hi")
    entries = written(grouped.where("copies = 1 OR whole").select("anchor", "copies", "r.*").unionByName(own), "entries")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, mark, raw, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(wanted)
                hashes = words(raw)[0].tobytes() if any(w["anchor"] & 1 for w in wanted) else b""
                held = [hashes[8 * w["lo"] : 8 * (w["hi"] + passage)] if w["anchor"] & 1 else raw[w["lo"] : w["hi"] + length] for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([w["anchor"] for w in wanted], pa.int64()), pa.array([w["copies"] for w in wanted], pa.int64()), pa.array([doc] * n, pa.int64()), pa.array([mark] * n, pa.int64()), pa.array([w["lo"] for w in wanted], pa.int32()), pa.array(held, pa.binary())], names=["anchor", "copies", "doc", "mark", "lo", "bytes"])

    wanted = entries.groupBy("doc", "mark").agg(F.collect_list(F.struct("anchor", "copies", "lo", "hi")).alias("wanted"))  # as many as a text has anchors
    sources = keyed.select("doc", "mark", "text").join(wanted, ["doc", "mark"])
    pieces = written(sources.select("doc", "mark", "text", "wanted").mapInArrow(cut, "anchor long, copies long, doc long, mark long, lo int, bytes binary").dropDuplicates(["anchor", "doc", "mark", "lo"]), "pieces")
    sizes = pieces.groupBy("anchor").agg(F.sum(F.length("bytes")).alias("size"))
    sized = pieces.join(sizes, "anchor")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            u = held[0][0] & 1
            if u:  # copies in several documents are an owner of their own
                names: dict[tuple, int] = {}
                found = repeated_in([np.frombuffer(h[5], "<u8") for h in held], passage, [names.setdefault(h[2:4] if h[1] == 1 else (h[0], i), len(names)) for i, h in enumerate(held)])
            else:
                found = repeated_in([h[5] for h in held], length)
            out = [(doc, mark, u, lo + a, lo + b) for (_, copies, doc, mark, lo, _), starts in zip(held, found) if copies == 1 for a, b in _runs(starts, lengths[u])]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["doc", "mark", "unit", "start", "end"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (size >= block and row[0] != held[-1][0] or (row[0] ^ held[-1][0]) & 1):
                    yield flush()
                    size = 0
                held.append(row)
                size += len(row[5])
        if held:
            yield flush()

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u, copies, doc, mark, lo, raw in zip(*(c.to_pylist() for c in batch.columns)):
                values = np.frombuffer(raw, "<u8") if u else _BYTES[np.frombuffer(raw, np.uint8)]
                x, y = (rolling(values, lengths[u], seed).view(np.int64) for seed in (1, 2))
                n = len(x)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.full(n, copies)), pa.array(np.full(n, doc)), pa.array(np.full(n, mark)), pa.array(np.full(n, u, np.int32)), pa.array((np.arange(n) + lo).astype(np.int32))], names=["x", "y", "copies", "doc", "mark", "unit", "start"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(doc, mark, u, a, b) for doc, mark, u, starts in zip(*(c.to_pylist() for c in batch.columns)) for a, b in _runs(np.array(starts), lengths[u])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["doc", "mark", "unit", "start", "end"])

    found = "doc long, mark long, unit int, start int, end int"
    cool = sized.where(F.col("size") <= hot).select("anchor", "copies", "doc", "mark", "lo", "bytes")
    # blocks cost time, not bytes: as many tasks as blocks, which are not merged by size
    n = -(-(pieces.agg(F.sum(F.length("bytes"))).first()[0] or 0) // block)
    met = cool.repartition(int(max(1, min(n, WAVES * spark.sparkContext.defaultParallelism))), "anchor").sortWithinPartitions(unit, "anchor").mapInArrow(blocks, found)
    single = sized.where(F.col("size") > hot).select(unit.alias("unit"), "copies", "doc", "mark", "lo", "bytes").mapInArrow(strings, "x long, y long, copies long, doc long, mark long, unit int, start int")
    twice = single.groupBy("unit", "x", "y").agg(F.sum("copies").alias("n"), F.max("copies").alias("most"), (first < last).alias("apart"))
    twice = twice.where("n > 1 AND (unit = 0 OR most > 1 OR apart)").select("unit", "x", "y")
    places = single.join(twice, ["unit", "x", "y"], "left_semi").groupBy("doc", "mark", "unit", F.floor(F.col("start") / RUN)).agg(F.array_sort(F.collect_set("start")).alias("starts"))
    split = places.select("doc", "mark", "unit", "starts").mapInArrow(joined, found)
    return covered.unionByName(copied).unionByName(written(met, "met")).unionByName(split)


def _merged(cuts: list, unit: int) -> list[list[int]]:
    out: list[list[int]] = []
    for s in cuts:
        if s["unit"] != unit:
            continue
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["start"], s["end"]])
    return out


def _without(raw: bytes, cuts: list[list[int]]) -> bytes:
    """What is left of raw; the cuts ascend, but may overlap."""
    stays, at = [], 0
    for a, b in cuts:
        stays.append(raw[at : max(at, a)])
        at = max(at, b)
    return b"".join([*stays, raw[at:]])


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, kept: bool = False, **more: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_words and, if asked for, kept (the bytes that stay, which kept_sha256 digests) and text (what stays of them without the passages too) of every row."""
    found = spans(docs, text, length, **more).groupBy("doc", "mark").agg(F.collect_set(F.struct("unit", "start", "end")).alias("spans"))
    joined = _keyed(docs, text).join(found, ["doc", "mark"], "left").select("doc_id", "text", F.array_sort("spans").alias("spans"))
    types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "n_passages": pa.int64(), "n_passage_words": pa.int64()} | ({"kept": pa.binary(), "text": pa.string()} if kept else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, raw, cuts in zip(*(c.to_pylist() for c in batch.columns)):
                removed, passages = _merged(cuts or [], 0), _merged(cuts or [], 1)
                rest = _without(raw, removed)
                row = (doc_id, len(raw), len(raw) - len(rest), len(removed), hashlib.sha256(rest).hexdigest(), len(passages), sum(b - a for a, b in passages))
                if kept:
                    _, starts, ends = words(raw) if passages else ((),) * 3
                    row += (rest, _without(raw, sorted([*removed, *([int(starts[a]), int(ends[b - 1])] for a, b in passages)])).decode("utf-8", "replace"))
                out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types.values())], names=list(types))

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long" + ", kept binary, text string" * kept)
