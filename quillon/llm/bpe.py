"""Byte-level BPE encoding and decoding by monoid tree reduction.

An encoded span is an element of a monoid whose product is "encode the concatenation". A document is halved until a
part is a leaf; neighbours are joined by encoding a window around the seam again, which grows until the tokens outside
it provably stay as they are; decoding concatenates byte strings up the same tree. There are two levels of seams:

* Between the pattern's matches. A match of the left part is final if it and what the pattern has looked at end before
  the seam. Matching goes on from the end of the last final match until it meets a match boundary of the right part:
  the pattern never looks back, so from a common boundary on both tokenisations are the same.
* Inside a long match. Let two neighbouring tokens be *stable* if encoding their joined bytes gives the two tokens
  again. A sequence of tokens is the encoding of its bytes if and only if every neighbouring pair is stable (the first
  merge across a token boundary would also be made in that pair alone). So the window grows until the pairs at both of
  its ends are stable.

Cases: a null text is the empty text and has no tokens; texts of any length are encoded whole; equal rows give equal
rows; other columns of the input are kept unless named in the output.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import small_batches, text_bytes

#: A part of a document of so many characters is a leaf; a part of a match of so many bytes is one.
LEAF_CHARS, LEAF_BYTES = 8192, 64
#: Distinct matches whose ids a worker remembers before it starts anew.
REMEMBERED, LONGEST = 500_000, 64
#: Characters that the pattern may look at from a match's start besides the match itself (`'re` and its kind).
LOOK = 3


class _Memory(dict):
    """Matches and their packed ids; asks the codec for what it does not know."""

    def __init__(self, codec: Codec) -> None:
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        out = b"".join(i.to_bytes(4, "little") for i in self.codec.encode_match(piece.encode()))
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = out
        return out


class Codec:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES) -> None:
        import regex

        self.ranks, self.leaf_chars, self.leaf_bytes = ranks, leaf_chars, leaf_bytes
        # Rust's \s is White_Space; the class is spelt out so that both libraries agree on separators such as \x1c
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.memory = _Memory(self)
        self.stable = lru_cache(200_000)(lambda a, b: self._merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b])

    # -- inside a match

    def encode_match(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self._halves(piece)

    def _halves(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf_bytes:
            return self._merge(piece)
        mid = len(piece) // 2
        return self._join(self._halves(piece[:mid]), self._halves(piece[mid:]))

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        if self.stable(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            a, c = max(0, len(left) - k), min(len(right), k)
            window = self._merge(b"".join(self.bytes_of[i] for i in left[a:] + right[:c]))
            if (a == 0 or self.stable(left[a - 1], window[0])) and (c == len(right) or self.stable(window[-1], right[c])):
                return left[:a] + window + right[c:]
            k *= 4

    def _merge(self, piece: bytes) -> list[int]:
        """Merge the neighbours of lowest rank, the leftmost of equals, until none has a rank."""
        ranks = self.ranks
        if len(piece) <= 64:
            none, get = 1 << 40, ranks.get
            cut = list(range(len(piece) + 1))
            rank = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
            while rank and (best := min(rank)) != none:
                i = rank.index(best)
                del cut[i + 1], rank[i]
                if i < len(rank):
                    rank[i] = get(piece[cut[i] : cut[i + 2]], none)
                if i:
                    rank[i - 1] = get(piece[cut[i - 1] : cut[i + 1]], none)
            return [ranks[piece[i:j]] for i, j in zip(cut, cut[1:])]
        n = len(piece)
        end = list(range(1, n + 1))  # of the part that starts here; 0: no part starts here
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, m, e = heapq.heappop(heap)
            if end[i] != m or m >= n or end[m] != e:
                continue
            end[i], end[m] = e, 0
            if e < n:
                before[e] = i
                if (r := ranks.get(piece[i : end[e]])) is not None:
                    heapq.heappush(heap, (r, i, e, end[e]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:e])) is not None:
                heapq.heappush(heap, (r, p, i, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    # -- between matches

    def _node(self, text: str, lo: int, hi: int) -> tuple[list[str], list[bytes]]:
        if hi - lo <= self.leaf_chars:
            pieces = self.pattern.findall(text, lo, hi)
            return pieces, list(map(self.memory.__getitem__, pieces))
        mid = (lo + hi) // 2
        (lp, li), (rp, ri) = self._node(text, lo, mid), self._node(text, mid, hi)
        at, keep = mid, len(lp)
        while keep and (at == mid or at - len(lp[keep - 1]) + LOOK > mid):  # the last match kept must end, and have been seen to end, before the seam
            keep -= 1
            at -= len(lp[keep])
        seam, used, met = [], 0, mid
        while at != met:
            while met < at:  # the right part's next boundary
                met += len(rp[used])
                used += 1
            if at == met:
                break
            piece = self.pattern.match(text, at, hi).group()
            seam.append(piece)
            at += len(piece)
        return lp[:keep] + seam + rp[used:], li[:keep] + list(map(self.memory.__getitem__, seam)) + ri[used:]

    def encode(self, text: str) -> bytes:
        """The ids as packed little-endian unsigned 32-bit integers."""
        return b"".join(self._node(text, 0, len(text))[1])

    def decode(self, ids: memoryview | bytes) -> bytes:
        """The bytes of packed ids."""
        numbers = memoryview(ids).cast("I").tolist()

        def node(lo: int, hi: int) -> bytes:
            if hi - lo <= self.leaf_chars:
                return b"".join(map(self.bytes_of.__getitem__, numbers[lo:hi]))
            mid = (lo + hi) // 2
            return node(lo, mid) + node(mid, hi)

        return node(0, len(numbers))


@lru_cache(2)
def load(path: str, pattern: str) -> Codec:
    """The codec of a file of ranks; one for each worker."""
    with open(path, "rb") as f:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def encode_documents(df: DataFrame, text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, decoded: bool = False) -> DataFrame:
    """df without its text, with n_tokens and ids (packed little-endian unsigned 32-bit); with decoded, also the bytes that the ids decode to.

    path: the tokenizer's ranks; it must be found under the same path on every executor.
    """
    import pyspark.sql.types as T

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in (text, "n_tokens", "ids", "decoded")]
    source = df.select(*kept, text_bytes(df, text).alias("__text"))
    extra = [("n_tokens", T.LongType()), ("ids", T.BinaryType())] + [("decoded", T.BinaryType())] * decoded
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(n, t) for n, t in extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path, pattern)
        for batch in batches:
            ids = [codec.encode(v.as_py().decode("utf-8", "replace")) for v in batch.column("__text")]
            columns = [*(batch.column(c) for c in kept), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array([codec.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *(n for n, _ in extra)])

    return source.mapInArrow(run, schema)


def decode_documents(df: DataFrame, ids: str = "ids", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """df with the column decoded: the bytes of its packed ids; null ids decode to nothing."""
    import pyspark.sql.types as T

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kept = [c for c in df.columns if c != "decoded"]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path, pattern)
        for batch in batches:
            out = [codec.decode(v.as_py() or b"") for v in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*kept, "decoded"])

    return df.select(*kept).mapInArrow(run, schema)


def digests(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    out = encode_documents(df.select("doc_id", text), text, decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
