"""Near-duplicate documents by BagMinHash over multisets of word shingles.

A document is the multiset of its runs of five words (words stand between ASCII white space). Every shingle's weight, its
number of occurrences, is discretised into unit levels that are gathered in blocks of 1, 2, 4, ... levels. Each block is
a Poisson process whose rate is its number of levels; its points have a time, a level and one of REGISTERS registers,
all hashed from the shingle and the block. A point counts if its level is below the weight. A register keeps the least
time, so two signatures agree in a register with a probability equal to the weighted Jaccard similarity. Points come in
order of time, so a block is left as soon as its next time is later than the latest register.

Documents with the same words are one entry, named by a number of its own: neither doc_ids nor 64-bit hashes stand for a
text. Signatures are banded. In a bucket every entry is compared with the smallest one (its lead), so a group of g
entries gives g - 1 candidates; in buckets whose entries are then still in several components, also with the one that
has most links. What leads cannot show is compared afterwards, where components are left: entries of different
components whose signatures agree nearly enough, in the first band that they share. A small bucket emits such pairs; a
large one is cut into blocks that verify them at once, best first, and emit only links that join components, so no group
emits all its pairs. All candidates are verified by the overlap of the multisets.

Cases: a null or empty text, or one of white space only, is alone in its class; a text of fewer than five words has one
shingle of all its words; a class is named by its smallest doc_id, null if none has one; several texts under one doc_id
are classed apart from each other, and only the one that the class is named after (of least hash) is kept; repeated rows
share a class, and all of the one that is kept are marked, of which deduplicated() keeps one; rows without a doc_id are
classed and dropped like others; an empty table gives no rows; extra columns are not read by classes().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import drop_written, pieces, small_batches, text_bytes, with_possible, written
from quillon.llm.components import components

WORDS, REGISTERS, BANDS = 5, 128, 32
#: Signatures agree in so many registers fewer than the threshold says when a pair is still verified (about 5 deviations).
SLACK = 0.18
#: A bucket of more documents than DENSE is verified inside its blocks of BLOCK documents on either side.
DENSE, BLOCK = 64, 1024
#: Pairs whose bands are compared at a time.
PAIRS = 4096
_G = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers whose bits all depend on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.cumprod(np.full(256, 0x5851F42D4C957F2D, np.uint64))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text number of every shingle, and the number of words of each text."""
    flat = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    space = (flat == 32) | (flat >= 9) & (flat <= 13)
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    owner = np.searchsorted(np.cumsum(lengths), starts - 1, "right")
    n = np.bincount(owner, minlength=len(texts))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), n
    # a word's hash: its bytes by powers of a multiplier, which begin anew every 256 bytes; it depends on the word alone
    word = np.cumsum(space[:-1] & ~space[1:])  # number of words begun before each byte but the first
    inside = ~space[1:]
    w = word[inside] - 1
    place = np.flatnonzero(inside) + 1 - starts[w]
    value = (flat[1:][inside].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 255]
    far = np.flatnonzero(place > 255)
    value[far] = _mix(value[far] + (place[far] >> 8).astype(np.uint64) * np.uint64(_G))
    h = np.add.reduceat(value, np.flatnonzero(place == 0))
    h = _mix(h + (ends - starts).astype(np.uint64) * np.uint64(_G))
    out = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        out += _mix(h[k : k + len(out)] + np.uint64((k + 1) * _G % (1 << 64)))
    whole = owner[: len(out)] == owner[WORDS - 1 :]
    short = np.flatnonzero((n > 0) & (n < WORDS))
    first = np.searchsorted(owner, short)
    extra = np.array([_mix(np.array([sum(int(x) * (2 * j + 1) for j, x in enumerate(h[a : a + c].tolist())) % (1 << 64)], np.uint64))[0] for a, c in zip(first.tolist(), n[short].tolist())], np.uint64)
    return np.concatenate((_mix(out[whole]), extra)), np.concatenate((owner[: len(out)][whole], short)), n


def multisets(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, hash) with their number of occurrences, sorted."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])]) if len(h) else np.zeros(0, np.int64)
    return h[first], o[first], np.diff(np.append(first, len(h)))


def signatures(hashes: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """REGISTERS least times of each of n multisets; infinite for an empty one."""
    register = np.full(n * REGISTERS, np.inf)
    blocks = np.frexp(weight.astype(float))[1]  # blocks 0, 1, ... of 1, 2, 4, ... levels reach a weight
    unit = np.repeat(np.arange(len(hashes)), blocks)
    k = np.arange(len(unit)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    doc, rate = owner[unit], np.exp2(k)
    below = weight[unit] - (rate - 1)  # levels of the block that the weight has
    state = _mix(hashes[unit] + k.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    time = np.zeros(len(unit))
    turn = 0
    while len(doc):
        state = state + np.uint64(_G)
        r = _mix(state)
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        if turn:  # registers only fall, so an old bound is right for what it drops
            late = register.reshape(n, REGISTERS).max(1) if turn % 4 == 0 or len(doc) < 4 * n else late
            keep = time < late[doc]
            doc, rate, below, state, time, r = (x[keep] for x in (doc, rate, below, state, time, r))
        q = _mix(r ^ np.uint64(0xA0761D6478BD642F))
        j = doc * REGISTERS + (q & np.uint64(REGISTERS - 1)).astype(np.int64)
        in_weight = (rate == 1) | ((q >> np.uint64(11)).astype(np.float64) * 2.0**-53 * rate < below)
        np.minimum.at(register, j[in_weight], time[in_weight])
        if not turn:
            late = register.reshape(n, REGISTERS).max(1)
        turn += 1
    return register.reshape(n, REGISTERS)


def band_keys(register: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bits = register.view(np.uint64).reshape(len(register), BANDS, -1)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(_G)
    for r in range(bits.shape[2]):
        key = _mix(key + bits[:, :, r])
    return key


def overlap(a: bytes, b: bytes, memory: dict, most: int = 256) -> float:
    """Weighted Jaccard similarity of two texts' multisets of shingles."""

    def of(t: bytes) -> tuple[np.ndarray, np.ndarray]:
        if t not in memory:
            if len(memory) > most:
                memory.clear()
            h, o, _ = shingles([t])
            memory[t] = multisets(h, o)[::2]
        return memory[t]

    (ha, na), (hb, nb) = of(a), of(b)
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    both = int(np.minimum(na[ia], nb[ib]).sum())
    total = int(na.sum() + nb.sum()) - both
    return both / total if total else 0.0


def signed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, mark (a hash of the text), content (a digest of the words; null if there are none), bands and sketch (a byte of each register)."""
    small_batches(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [v.as_py() for v in batch.column(2)]
            hashes, owner, n = shingles(texts)
            register = signatures(*multisets(hashes, owner), len(texts))
            keys, sketch = band_keys(register).view(np.int64), (_mix(register.view(np.uint64)) & np.uint64(255)).astype(np.uint8)
            content = [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() if c else None for t, c in zip(texts, n.tolist())]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(content, pa.binary()), bands, pa.array([s.tobytes() for s in sketch], pa.binary())], names=["doc_id", "mark", "content", "bands", "sketch"])

    return docs.select("doc_id", F.xxhash64(text).alias("mark"), text_bytes(docs, text).alias("text")).mapInArrow(run, "doc_id long, mark long, content binary, bands array<long>, sketch binary")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs a, b whose texts' similarity is at least the threshold."""
    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for batch in batches:
            good = [overlap(x.as_py(), y.as_py(), memory) >= least for x, y in zip(batch.column("ta"), batch.column("tb"))]
            yield pa.RecordBatch.from_arrays([batch.column(n).filter(pa.array(good, pa.bool_())) for n in ("a", "b")], names=["a", "b"])

    return two.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of one bucket and block at a time; the partition is sorted by them."""
    held: list[dict] = []
    key = None
    for batch in batches:
        t = {n: (np.array([*c.to_pylist(), None], object)[:-1] if pa.types.is_binary(c.type) else c.flatten().to_numpy().reshape(-1, BANDS) if pa.types.is_list(c.type) else c.to_numpy()) for n, c in zip(batch.schema.names, batch.columns)}
        cuts = [0, *(np.flatnonzero((t["bucket"][1:] != t["bucket"][:-1]) | (t["block"][1:] != t["block"][:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                if held and (t["bucket"][a], t["block"][a]) != key:
                    yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}
                    held = []
                key = t["bucket"][a], t["block"][a]
                held.append({n: c[a:b] for n, c in t.items()})
    if held:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def _plausible(t: dict[str, np.ndarray], least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs (side 0, side 1) of different components, in the first band that they share, whose sketches agree nearly enough.

    The bands are compared by their keys: sketches may agree by chance in a band whose bucket the two do not share.
    """
    sketch = np.frombuffer(b"".join(t["sketch"]), np.uint8).reshape(-1, REGISTERS)
    left, right, band = np.flatnonzero(t["side"] != 1), np.flatnonzero(t["side"] != 0), int(t["band"][0])
    once = (lambda a, b: a < b) if t["side"][0] == 2 else (lambda a, b: a != b)  # noqa: E731 - a block against itself, or against another
    for lo in range(0, len(left), 32):
        l = left[lo : lo + 32]
        agree = (sketch[l][:, None] == sketch[right][None]).mean(2)
        i, j = np.nonzero((agree >= least - SLACK) & (t["component"][l][:, None] != t["component"][right][None, :]) & once(t["id"][l][:, None], t["id"][right][None, :]))
        first = np.concatenate([np.zeros(0, bool), *((t["bands"][l[i[k : k + PAIRS]]] == t["bands"][right[j[k : k + PAIRS]]]).argmax(1) == band for k in range(0, len(i), PAIRS))])
        i, j = i[first], j[first]
        yield l[i], right[j], agree[i, j]


def _sparse(least: float) -> object:
    """The task that emits the plausible pairs of small buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            for i, j, _ in _plausible(t, least):
                a, b = t["id"][i], t["id"][j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _dense(least: float) -> object:
    """The task that verifies the plausible pairs of a block of a large bucket at once, best first; only links that join components leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while (y := root.get(x, x)) != x:  # noqa: B023 - used in this turn only
                    root[x] = root.get(y, y)  # noqa: B023
                    x = y
                return x

            memory: dict = {}
            out: tuple[list, list] = ([], [])
            for i, j, agree in _plausible(t, least):
                for k in np.argsort(-agree, kind="stable").tolist():
                    a, b = find(int(t["component"][i[k]])), find(int(t["component"][j[k]]))
                    if a != b and overlap(t["text"][i[k]], t["text"][j[k]], memory, 4096) >= least:
                        root[max(a, b)] = min(a, b)
                        out[0].append(int(t["id"][i[k]])), out[1].append(int(t["id"][j[k]]))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    return run


def _agreeing(pairs: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    """The pairs a, b whose sketches agree nearly enough to be verified."""
    sketch = entries.select("id", "sketch")
    both = pairs.join(sketch.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(sketch.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint8).reshape(-1, REGISTERS) for n in ("sa", "sb"))
            good = pa.array((x == y).mean(1) >= least - SLACK)
            yield pa.RecordBatch.from_arrays([batch.column(n).filter(good) for n in ("a", "b")], names=["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _place(doc_id: Column, mark: Column) -> Column:
    """A row's doc_id and mark as one string, which is never null."""
    return F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), mark.cast("string"))


def _texts(docs: DataFrame, text: str, ids: DataFrame, entries: DataFrame) -> DataFrame:
    """id and text of the entries in ids, read from one row of each; the texts of other rows are not shuffled, but for a few."""
    wanted = written(ids.join(entries.select("id", "doc_id", "mark"), "id").select("id", _place(F.col("doc_id"), F.col("mark")).alias("place")), "places")
    every = docs.select(_place(F.col("doc_id"), F.xxhash64(text)).alias("place"), text_bytes(docs, text).alias("text"))
    few = with_possible(every, "place", wanted.select("place")).where("possible").drop("possible")
    return written(few.join(wanted, "place").groupBy("id").agg(F.first("text").alias("text")), "texts", "zstd")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def classes(docs: DataFrame, text: str = "text", least: float = 0.8) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), class_size and kept (whether it is the one that stays) of every row."""
    return _classed(docs, text, least).drop("mark", "alone")


def _classed(docs: DataFrame, text: str, least: float) -> DataFrame:
    """The columns of classes(), and mark and alone of every row."""
    sketches = written(signed(docs, text), "signatures")
    # the entry's row is the smallest; rows with a doc_id come first
    name = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("name")
    entries = sketches.where("content IS NOT NULL").groupBy("content").agg(name, F.count("*").alias("rows"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    # numbers in the order of the rows: a bucket's lead is its first document, which copies made from it are all like
    entries = written(entries.orderBy("name").select(F.monotonically_increasing_id().alias("id"), "content", "name.*", "rows", "bands", "sketch"), "entries")
    banded = entries.select("id", F.posexplode("bands").alias("band", "bucket"))
    leads = banded.groupBy("bucket").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1")
    members = written(banded.join(leads, "bucket"), "members")
    done, links = None, None
    for turn in range(2):  # leads are the smallest documents; then, where components are left, those with most links
        if turn:
            ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("links"))
            ranked = members.join(open_buckets, "bucket", "left_semi").join(ends, "id", "left")
            leads = written(ranked.groupBy("bucket").agg(F.max_by(F.struct("id", "component"), F.struct(F.coalesce("links", F.lit(0)), -F.col("id"))).alias("l")).select("bucket", "l.*"), "leads")
            found = members.join(leads.select("bucket", F.col("id").alias("b"), F.col("component").alias("c")), "bucket").where("component <> c")
        else:
            found = members.where("id <> b")
        found = found.select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()
        pairs = written(_agreeing(found if done is None else found.join(done, ["a", "b"], "left_anti"), entries, least), "candidates")
        texts = _texts(docs, text, written(_ends(pairs), "ends"), entries)
        new = written(_verified(pairs, texts, least), "links")
        drop_written(texts)
        done, links = (pairs, new) if done is None else (done.unionByName(pairs), links.unionByName(new))
        # the buckets whose documents are still in several components
        label = components(links)
        placed = written(members.drop("b", "component").join(label, "id", "left").select("bucket", "band", "n", "id", F.coalesce("component", "id").alias("component")), "members")
        drop_written(members)
        members = placed
        open_buckets = written(members.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket"), "open-buckets")
    still = members.join(open_buckets, "bucket", "left_semi").withColumn("s", F.when(F.col("n") > DENSE, F.ceil(F.col("n") / BLOCK)).otherwise(1))
    own = F.pmod(F.xxhash64("id", F.lit(5)), F.col("s"))
    # every two blocks meet once; a block meets itself as side 2
    sides = still.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)))
    block = F.least("own", "other") * 65536 + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    sides = sides.select("bucket", block.alias("block"), "band", side.alias("side"), "id", "component", "n")
    sparse = sides.where(f"n <= {DENSE}").drop("n").join(entries.select("id", "sketch", "bands"), "id")
    more = sparse.repartition("bucket", "block").sortWithinPartitions("bucket", "block").mapInArrow(_sparse(least), "a long, b long").distinct()
    more = written(more.select(F.col("b").alias("a"), F.col("a").alias("b")).join(done, ["a", "b"], "left_anti"), "candidates")
    crowd = written(still.where(f"n > {DENSE}").select("id").distinct(), "crowd")
    texts = _texts(docs, text, written(_ends(more).unionByName(crowd).distinct(), "ends"), entries)
    second = written(_verified(more, texts, least), "links")
    dense = sides.where(f"n > {DENSE}").drop("n").join(entries.select("id", "sketch", "bands"), "id").join(texts, "id")
    third = written(dense.repartition("bucket", "block").sortWithinPartitions("bucket", "block").mapInArrow(_dense(least), "a long, b long"), "links")
    drop_written(texts)
    drop_written(members)
    every = components(links.unionByName(second).unionByName(third))
    own = entries.select("content", "id", "none", "doc_id", "mark", "rows").join(every, "id", "left").withColumn("component", F.coalesce("component", "id"))
    # a class is named by the smallest row of its entries; most entries are classes of their own
    named = own.groupBy("component").agg(F.min(F.struct("none", "doc_id", "mark")).alias("name"), F.sum("rows").alias("class_size"))
    placed = written(own.select("content", "component").join(named, "component").select("content", F.col("name.doc_id").alias("class_id"), F.col("name.mark").alias("class_mark"), "class_size"), "classes")
    out = sketches.select("doc_id", "mark", "content").join(placed, "content", "left")
    alone = F.col("content").isNull()
    kept = alone | F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("mark") == F.col("class_mark"))
    return out.select("doc_id", "mark", alone.alias("alone"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, 1).otherwise(F.col("class_size")).cast("long").alias("class_size"), kept.alias("kept"))


def deduplicated(docs: DataFrame, text: str = "text", least: float = 0.8) -> DataFrame:
    """docs with one document of each class: the row that names it; of repeated rows of that doc_id and text, one.

    Texts without words are in no class, but of repeated rows of them one stays too. Only the rows that may have to go
    are looked up; the texts of the others are not shuffled.
    """
    found = _classed(docs, text, least).select(_place(F.col("doc_id"), F.col("mark")).alias("__place"), "kept")
    doubtful = written(found.groupBy("__place").agg(F.bool_and("kept").alias("__kept"), F.count("*").alias("n")).where("n > 1 OR NOT __kept").select("__place", "__kept"), "doubtful")
    flagged = with_possible(docs.withColumn("__place", _place(F.col("doc_id"), F.xxhash64(text))), "__place", doubtful.select("__place"), "__possible")
    looked_up = flagged.where("__possible").join(doubtful, "__place", "left").where("coalesce(__kept, true)").dropDuplicates(["__place"])
    return flagged.where("NOT __possible").select(*docs.columns).unionByName(looked_up.select(*docs.columns))
