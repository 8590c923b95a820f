"""Token ids in binary files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Steps, all distributed: encode each text and keep the packed ids in a written table; count the ids over all documents;
rank them, the most frequent first (ties: smaller id), so that common ids take one byte; order the documents by range
partitions of doc_id; each partition writes its files; a last pass reads the files back.

A file (``p<partition>-<number>.qtok``) holds whole documents: a header of seven little-endian unsigned 64-bit integers
(magic, partition, ids of the partition before this file, documents, those of them without a doc_id, which come first,
ids, vocabulary), the doc_ids (signed 64-bit; 0 where there is none), and two coded number lists, one of the documents' lengths, one of the ranked ids. A coded list is its control bytes (2 bits
for each number: its length in bytes less one, four numbers a byte) followed by its data bytes. ``ranks.bin`` has the id
of every rank. A file is written under a temporary name and renamed, and its content depends only on the input, so a
task that runs twice does no harm.

Cases: a null or empty text has only the end id; rows without a doc_id come before all others; equal doc_ids, null
among them, are ordered by length, a hash of the ids and the ids, so that they need not lie in one partition; an empty
table gives no files and no rows; special tokens' strings in a text are ordinary text; extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import drop_written, new_path, pieces, qualified, small_batches, written

MAGIC = int.from_bytes(b"QTOK0002", "little")
HEADER = "<7Q"
#: Ids in a file and in a partition (both at most one document more); bytes, about, of the chunks that a worker remembers,
#: of which each takes ENTRY beside its characters.
FILE_IDS, PARTITION_IDS, REMEMBERED, ENTRY = 1 << 21, 1 << 24, 400_000_000, 190

_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> bytes:
    """Control bytes, then data bytes, of unsigned 32-bit numbers."""
    values = np.ascontiguousarray(values, "<u4")
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = extra
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= extra[:, None]]
    return control.astype(np.uint8).tobytes() + data.tobytes()


def unpack(raw: bytes | memoryview, n: int) -> tuple[np.ndarray, int]:
    """n numbers and the bytes that they took; the lengths come from a table of the control bytes."""
    control = np.frombuffer(raw, np.uint8, -(-n // 4))
    lengths = _LENGTHS[control].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    size = int(ends[-1]) if n else 0
    data = np.zeros(size + 3, np.uint8)
    data[:size] = np.frombuffer(raw, np.uint8, size, len(control))
    at = ends - lengths
    word = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        word |= data[at + k].astype(np.uint32) << np.uint32(8 * k)
    return word & _MASKS[lengths], len(control) + size


#: A space after another white space character, or at an end: no place to cut.
_ODD = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] |^ | $"


def _places(values: list, what: object) -> list[int]:
    """Where a value stands in a list."""
    out, at = [], -1
    try:
        while True:
            at = values.index(what, at + 1)
            out.append(at)
    except ValueError:
        return out


class Encoder:
    """Encodes texts with the tokenizers library, remembering the ids of chunks between spaces.

    A space after a character that is not white space always begins a new match of the byte-level pattern, and nothing
    before it matters to what follows; so the chunks between such spaces can be encoded apart. Texts of other
    tokenizers are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import json

        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        pre = model.get("pre_tokenizer") or {}
        self.chunked = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not model.get("normalizer")
        self.size = self.tokenizer.get_vocab_size()
        if self.chunked:
            lengths = np.zeros(self.size, np.int64)
            for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
                lengths[i] = len(token)  # byte-level tokens have one character for each byte
            self.lengths = lengths
            self.tokenizer.model._resize_cache(0)
        self.memory: dict[str, bytes] = {}
        self.held = 0
        self.width = "<u2" if self.size <= 1 << 16 else "<u4"

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.width).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        """Remember the ids of chunks, each with the space before it."""
        good = [c for c in chunks if not c[-1].isspace()]
        if len(good) < len(chunks):  # what ends in white space is only ever at a text's end
            last = [c for c in chunks if c[-1].isspace()]
            self.memory.update(zip(last, self._whole([" " + c for c in last])))
        groups = [good[i : i + 200] for i in range(0, len(good), 200)]
        step = np.dtype(self.width).itemsize
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.width)
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([(len(c) if c.isascii() else len(c.encode())) + 1 for c in group]))
            raw, lo = ids.tobytes(), 0
            for c, hi in zip(group, (step * (cuts + 1)).tolist()):
                self.memory[c] = raw[lo:hi]
                lo = hi

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (an Arrow array of strings), each text's followed by the end id, and the texts' numbers of ids."""
        odd = np.asarray(pc.match_substring_regex(texts, _ODD)) if self.chunked else np.ones(len(texts), bool)
        cut = pc.split_pattern(texts, " ")
        first = np.asarray(cut.offsets)[:-1] - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        found = list(map(self.memory.get, chunks))
        missing = _places(found, None)
        if missing:
            new = [chunks[i] for i in missing if chunks[i]]
            size = sum(map(len, new)) + ENTRY * len(new)
            if self.held + size > REMEMBERED:
                self.memory, self.held = {}, 0
            self.held += size
            self._learn(new)
            for i in missing:
                found[i] = self.memory.get(chunks[i], b"")
        # a text's first chunk has no space before it; an odd text is encoded whole, as if it were its first chunk
        heads = pc.if_else(pa.array(odd), texts, cut.flatten().take(pa.array(first))).to_pylist()
        parts = found + self._whole(heads)
        table = np.frombuffer(b"".join(parts), self.width)
        step = np.dtype(self.width).itemsize
        lengths = np.array([len(x) // step for x in parts], np.int64)
        offsets = np.cumsum(lengths) - lengths
        which = np.asarray(coded.indices).astype(np.int64)
        which[first] = len(found) + np.arange(len(heads))
        n = lengths[which]
        if odd.any():
            owner = np.repeat(np.arange(len(texts)), np.diff(np.append(first, len(which))))
            rest = odd[owner]
            rest[first] = False
            n[rest] = 0
        ends = np.cumsum(n)
        ids = table[np.repeat(offsets[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        per_text = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
        return np.insert(ids, np.cumsum(per_text), np.array(end_id, self.width)), per_text + 1


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def encoded(df: DataFrame, text: str = "text", path: str | None = None, end_id: int = 2) -> DataFrame:
    """doc_id, n_tokens and ids (packed unsigned 16- or 32-bit, by the vocabulary) of every text, the end id last."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    small_batches(df.sparkSession, 2000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in pieces(batches, 6 << 20):
            if not batch.num_rows:
                continue
            flat, n = encoder.encode(batch.column(1).cast(pa.string()), end_id)
            ends = np.append(0, np.cumsum(n)).astype(np.int32) * np.int32(flat.itemsize)
            ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), ids], names=["doc_id", "n_tokens", "ids"])

    return df.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def ranking(tokens: DataFrame) -> tuple[np.ndarray, int]:
    """The id of every rank, most frequent first, and the number of all ids; at most one row for each id reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                counts = np.bincount(np.concatenate([_ids(raw, n) for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]), minlength=len(total))
                counts[: len(total)] += total
                total = counts
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    rows = tokens.select("n_tokens", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").collect()
    return np.array([r.id for r in rows], "<u4"), sum(r.n for r in rows)


def write_files(tokens: DataFrame, to: str) -> DataFrame:
    """Write the token table as files under to; the written index: partition, path, docs, ids of each file."""
    to = qualified(tokens.sparkSession, to)
    by_rank, total = ranking(tokens)
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, number = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        lengths: list[int] = []
        ids: list[np.ndarray] = []
        out: list[tuple] = []

        def flush() -> None:
            nonlocal before, number
            if not docs:
                return
            all_ids = rank_of[np.concatenate(ids)]
            nulls = docs.count(None)
            body = struct.pack(HEADER, MAGIC, part, before, len(docs), nulls, len(all_ids), len(by_rank)) + np.array([0] * nulls + docs[nulls:], "<i8").tobytes() + pack(np.array(lengths)) + pack(all_ids)
            name = f"p{part:06d}-{number:06d}.qtok"
            put(to, name, body)
            out.append((part, name, len(docs), len(all_ids)))
            before, number = before + len(all_ids), number + 1
            docs.clear(), lengths.clear(), ids.clear()

        held = 0
        for batch in batches:
            for d, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                docs.append(d), lengths.append(n), ids.append(_ids(raw, n))
                held += n
                if held >= FILE_IDS:
                    flush()
                    held = 0
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["part", "name", "docs", "n"])

    put(to, "ranks.bin", by_rank.tobytes())
    parts = max(1, -(-total // PARTITION_IDS), min(tokens.rdd.getNumPartitions(), -(-total // FILE_IDS)))
    order = ["doc_id", "n_tokens", "hash"]
    ordered = tokens.select("doc_id", "n_tokens", "ids", F.xxhash64("ids").alias("hash")).repartitionByRange(int(parts), *order).sortWithinPartitions(*order, "ids").drop("hash")
    return written(ordered.mapInArrow(run, "part long, name string, docs long, n long"), "token-index")


def put(to: str, name: str, content: bytes) -> None:
    """Write one file under a temporary name and rename it."""
    import uuid

    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(to)
    system.create_dir(base, recursive=True)
    temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as f:
        f.write(content)
    system.move(temporary, f"{base}/{name}")


def get(at: str, name: str) -> bytes:
    """One file's content."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(at)
    with system.open_input_stream(f"{base}/{name}") as f:
        return f.read()


def read_files(index: DataFrame, at: str, ids: bool = False) -> DataFrame:
    """The documents of the files in the index: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (packed unsigned 32-bit)."""
    spark, at = index.sparkSession, qualified(index.sparkSession, at)
    # one row for each 16 million ids: running sums of these are small enough for one task
    sums = index.groupBy("part").agg(F.sum("n").alias("n"))
    bases = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = None
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if by_rank is None:
                    by_rank = np.frombuffer(get(at, "ranks.bin"), "<u4")
                raw = memoryview(get(at, name))
                magic, _, start, n_docs, nulls, n_ids, _ = struct.unpack_from(HEADER, raw)
                if magic != MAGIC:
                    raise ValueError(f"{name} is not a token file")
                at_byte = struct.calcsize(HEADER) + 8 * n_docs
                docs = np.frombuffer(raw, "<i8", n_docs, struct.calcsize(HEADER))
                lengths, took = unpack(raw[at_byte:], n_docs)
                ranked, _ = unpack(raw[at_byte + took :], n_ids)
                flat = by_rank[ranked].tobytes()
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                spans = [flat[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array(docs, mask=np.arange(n_docs) < nulls), pa.array(starts + (start + base)), pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(x) for x in spans], pa.int64())]
                if ids:
                    columns.append(pa.array(spans, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    files = index.join(bases, "part").select("name", "base").repartition(max(1, min(index.count(), 4 * spark.sparkContext.defaultParallelism)), "name")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def token_files(df: DataFrame, text: str = "text", path: str | None = None, end_id: int = 2, to: str | None = None) -> DataFrame:
    """Encode, write the files and read them back."""
    to = to or new_path(df.sparkSession, "tokens")
    tokens = written(encoded(df, text, path, end_id), "token-stage", "zstd")
    index = write_files(tokens, to)
    drop_written(tokens)
    return read_files(index, to)
