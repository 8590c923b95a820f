"""Which terms and which pairs of sources tell the sources of a language apart: exact divergences by upper-bound search.

A term is a run of characters other than ASCII non-letters, with only A-Z lower-cased. A language keeps the terms that at
least LEAST_DOCS of its documents hold. A group (language, source) gives a kept term of count c the probability
p = 1 + floor(SCALE * (c + 2) / (N + 2 * V)), N being the group's count of all V kept terms; q is the same for the whole
language. f(p, q) = floor((p - q)^2 / (p + q)), in integers throughout.

Top terms of a group (those with p > q, by f): its terms lie in buckets of nearly equal counts (eight for each power of
two). f grows with p and falls with q, so the f of a bucket's largest count and the least probability that the language
gives any of its terms bounds all of its terms. Buckets are evaluated best bound first, STEP at once and twice as many in
each further round, until the bounds of the unseen ones are strictly below the group's k-th value; terms are joined in
only for evaluated buckets.

Pairs: f summed over all kept terms. Terms in neither source are counted, terms in one are summed by the group's count
buckets (distinct counts), and what terms in both add to that is computed from their postings, which are dealt into
chunks of about CHUNK postings by term, so a source or term of a third of the corpus is spread over all of them.

Cases: null text, lang and source are ''; a text without a term still makes its group occur; a language without kept
terms has pairs of value 0 and no terms; a language of one source has no pairs; repeated rows are documents of their
own; texts of any length are read whole, in pieces; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import drop_written, small_batches, text_bytes, written

SCALE, LEAST_DOCS, TOP = 1_000_000_000, 10, 10
#: Bytes of texts that a task counts before it hands the counts on, and of a longer text that are split at once.
HELD, PIECE = 1 << 24, 1 << 22
#: Postings in a chunk; buckets of a group that the first round evaluates; parts of the joins with the groups' sizes.
CHUNK, STEP, SALT = 1 << 18, 4, 16
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)).lower()


def terms_of(raw: bytes) -> tuple[pa.Array, np.ndarray]:
    """The terms of UTF-8 bytes and where each starts."""
    flat = np.frombuffer(raw.translate(_LETTERS), np.uint8)
    letter = flat != 32
    edges = np.flatnonzero(np.diff(letter.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(ends - starts))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat[letter])]), starts


def term_counts(texts: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Group, term, occurrences and documents of all terms of some texts; groups: a number for each text."""
    sizes = np.array([len(t) + 1 for t in texts])
    terms, starts = terms_of(b" ".join(texts))
    coded = terms.dictionary_encode()
    k = max(1, len(coded.dictionary))
    doc = np.searchsorted(np.cumsum(sizes), starts, "right")
    # by document first, as a term counts once for each
    key, times = np.unique(doc * k + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    key = groups[key // k] * k + key % k
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.diff(key, prepend=-1))
    return key[heads] // k, coded.dictionary.take(pa.array(key[heads] % k)), np.add.reduceat(times[order], heads) if len(heads) else heads, np.diff(np.append(heads, len(key)))


def long_counts(raw: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """The same of one text of any length, in pieces that end between terms."""
    total: Counter = Counter()
    lo = 0
    while lo < len(raw):
        hi = min(len(raw), lo + PIECE)
        while hi < len(raw) and _LETTERS[raw[hi]] != 32:
            hi += 1
        _, terms, times, _ = term_counts([raw[lo:hi]], np.zeros(1, np.int64))
        for term, n in zip(terms.to_pylist(), times.tolist()):
            total[term] += n
        lo = hi
    return np.zeros(len(total), np.int64), pa.array(list(total), pa.binary()), np.array(list(total.values()), np.int64), np.ones(len(total), np.int64)


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, c (occurrences) and docs, in parts that are to be summed; the term '' stands for the group itself."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple, int] = {}  # of the groups in hand
        held: list[bytes] = []
        groups: list[int] = []
        size = 0

        def out(found: tuple, own: list[tuple]) -> pa.RecordBatch:
            group, terms, times, seen = found
            n = len(own)
            at = pa.array(np.concatenate((group, np.arange(n))))
            parts = pa.concat_arrays([terms, pa.array([b""] * n, pa.binary())]), pa.array(np.concatenate((times, np.zeros(n, np.int64)))), pa.array(np.concatenate((seen, np.zeros(n, np.int64))))
            return pa.RecordBatch.from_arrays([pa.array([g[i] for g in own], pa.string()).take(at) for i in (0, 1)] + list(parts), names=["lang", "source", "term", "c", "docs"])

        for batch in batches:
            for a, b, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if len(raw) > PIECE:
                    yield out(long_counts(raw), [(a, b)])
                    continue
                groups.append(names.setdefault((a, b), len(names)))
                held.append(raw)
                size += len(raw) + 64
                if size > HELD:
                    yield out(term_counts(held, np.array(groups)), list(names))
                    held, groups, names, size = [], [], {}, 0
        if held:
            yield out(term_counts(held, np.array(groups)), list(names))

    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    parts = docs.select(empty(lang), empty(source), text_bytes(docs, text).alias("text")).mapInArrow(run, "lang string, source string, term binary, c long, docs long")
    return parts.withColumn("term", F.col("term").cast("string"))


def probability(c: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (c + 2) / (n + 2 * v)), exact at any size."""
    return F.lit(1).cast("long") + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (c + 2).cast("decimal(20,0)"), (n + 2 * v).cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are at most SCALE + 1, so nothing leaves 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _bucket(c: Column) -> Column:
    """Counts below 8 apart, then eight buckets for each power of two."""
    power = F.length(F.bin(c)) - 1
    return F.when(c < 8, c).otherwise(F.expr("8L") * power + F.call_function("shiftright", c, power - 3) - 24).cast("int")


def postings(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """The kept terms' postings (lang, source, term, c, l: the language's count) and the groups (lang, source, n, v, nl)."""
    parts = counted(docs, text, lang, source).repartition("lang", "term")  # one shuffle serves all that follows
    sums = parts.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    both = sums.withColumns({"all_docs": F.sum("docs").over(same), "l": F.sum("c").over(same), "first": F.col("source") == F.min("source").over(same)})
    kept = written(both.where((F.col("all_docs") >= least_docs) | (F.col("term") == "")).select("lang", "source", "term", "c", "l", (F.col("first") & (F.col("term") != "")).alias("first")), "divergence-postings")
    groups = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count_if("first").alias("v"))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("nl"), F.sum("v").alias("v"))
    return kept.where("term <> ''").drop("first"), written(groups.drop("v").join(langs, "lang").select("lang", "source", "n", "v", "nl"), "divergence-groups")


def _with_groups(df: DataFrame, groups: DataFrame, salt: Column) -> DataFrame:
    """df with the sizes of each row's group; a group of very many rows is joined in SALT parts."""
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return df.withColumn("salt", F.pmod(salt, F.lit(SALT)).cast("int")).join(spread, ["lang", "source", "salt"]).drop("salt")


def top_terms(terms: DataFrame, k: int = TOP, work: list[tuple[int, int]] | None = None) -> DataFrame:
    """lang, source, term and f of every group's k terms of largest f with p > q, ties to smaller terms.

    terms: lang, source, term, p, q and bucket. work, if given, gets the numbers of evaluated and of all buckets.
    """
    bound = F.when(F.col("most") > F.col("least"), divergence(F.col("most"), F.col("least")))  # null: no term of the bucket has p > q
    buckets = terms.groupBy("lang", "source", "bucket").agg(F.max("p").alias("most"), F.min("q").alias("least")).withColumn("bound", bound).where("bound IS NOT NULL")
    # a group has at most some 500 buckets, whatever its size
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket"))
    buckets = written(buckets.select("lang", "source", "bucket", "bound", place.alias("place")), "divergence-buckets")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("f"), "term"))).where(F.col("rank") <= k)
    best, lo, step, evaluated = None, 0, STEP, 0
    wanted = buckets.where(F.col("place") <= step)
    while True:
        hi = lo + step
        found = terms.where("p > q").join(wanted.select("lang", "source", "bucket"), ["lang", "source", "bucket"]).select("lang", "source", "term", divergence(F.col("p"), F.col("q")).alias("f"))
        new = written(ranked(found if best is None else best.unionByName(found)).drop("rank"), "divergence-best")
        if best is not None:
            drop_written(best)
        best = new
        if work is not None:
            evaluated += wanted.count()
        # the k-th value of groups that have k terms; a bound equal to it may hide a smaller term of the same value
        kth = best.groupBy("lang", "source").agg(F.count("*").alias("have"), F.min("f").alias("kth")).where(F.col("have") >= k)
        rest = buckets.where(F.col("place") > hi).join(kth, ["lang", "source"], "left").where("kth IS NULL OR bound >= kth")
        lo, step = hi, 2 * step
        wanted = rest.where(F.col("place") <= lo + step).drop("have", "kth")
        if wanted.isEmpty():
            break
    if work is not None:
        work.append((evaluated, buckets.count()))
    return best


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def pair_sums(terms: np.ndarray, groups: np.ndarray, p: np.ndarray, p0: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of groups (numbers, the first smaller) what their common terms add to f beyond what either alone does.

    terms: numbers of the postings' terms; p and p0: the group's probability of the term, and of one that it lacks.
    """
    order = np.lexsort((groups, terms))
    terms, groups, p, p0 = terms[order], groups[order], p[order], p0[order]
    size = int(groups.max()) + 1 if len(groups) else 0
    keys, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, len(terms)):
        a = np.flatnonzero(terms[d:] == terms[:-d])
        if not len(a):
            break
        b = a + d
        value = _f(p[a], p[b]) - _f(p[a], p0[b]) - _f(p0[a], p[b]) + _f(p0[a], p0[b])
        key, at = np.unique(groups[a] * size + groups[b], return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, at, value)
        keys.append(key)
        values.append(total)
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, at, np.concatenate(values))
    return key // max(1, size), key % max(1, size), total


def pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, other and f (summed over all kept terms) of all ordered pairs of sources of a language.

    terms: lang, source, term, c, p and p0. The result has a row for each pair, as asked; nothing else grows with pairs but
    the distinct counts of a source.
    """
    n = terms.count()
    chunks = max(1, -(-n // CHUNK))

    def run(table: pa.Table) -> pa.Table:
        source = table.column("source").combine_chunks().dictionary_encode()
        term = table.column("term").combine_chunks().dictionary_encode()
        names = source.dictionary.to_pylist()
        by_name = np.argsort(np.argsort(np.array(names, object))) if names else np.zeros(0, np.int64)
        a, b, value = pair_sums(term.indices.to_numpy().astype(np.int64), by_name[source.indices.to_numpy()].astype(np.int64), table.column("p").to_numpy(), table.column("p0").to_numpy())
        ordered = sorted(names)
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(a), pa.string()), "source": pa.array([ordered[i] for i in a.tolist()], pa.string()), "other": pa.array([ordered[i] for i in b.tolist()], pa.string()), "f": pa.array(value)})

    dealt = terms.select("lang", "source", "term", "p", "p0", F.pmod(F.xxhash64("term"), F.lit(chunks)).alias("chunk"))
    common = dealt.groupBy("lang", "chunk").applyInArrow(run, "lang string, source string, other string, f long")
    common = common.unionByName(common.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "f")).groupBy("lang", "source", "other").agg(F.sum("f").alias("f"))
    none = F.when(F.col("v") > 0, probability(F.lit(0), F.col("n"), F.col("v")))
    named = groups.select("lang", "source", "v", none.alias("p0"))
    other = named.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    both = named.join(other, "lang").where("source <> other")
    base = both.select("lang", "source", "other", F.when(F.col("v") > 0, F.col("v") * divergence(F.col("p0"), F.col("q0"))).otherwise(F.lit(0).cast("long")).alias("f"))
    by_count = terms.groupBy("lang", "source", "c", "p", "p0").agg(F.count("*").alias("times"))
    alone = by_count.join(other, "lang").where("source <> other").groupBy("lang", "source", "other").agg(F.sum(F.col("times") * (divergence(F.col("p"), F.col("q0")) - divergence(F.col("p0"), F.col("q0")))).alias("f"))
    alone = written(alone, "divergence-alone")
    turned = alone.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "f")
    return base.unionByName(alone).unionByName(turned).unionByName(common).groupBy("lang", "source", "other").agg(F.sum("f").alias("f"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, k: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank: all other sources of the language, and the group's k top terms."""
    kept, groups = postings(docs, text, lang, source, least_docs)
    sized = _with_groups(kept, groups, F.xxhash64("term"))
    sizes = F.col("n"), F.col("v")
    terms = written(sized.select("lang", "source", "term", "c", probability(F.col("c"), *sizes).alias("p"), probability(F.lit(0), *sizes).alias("p0"), probability(F.col("l"), F.col("nl"), F.col("v")).alias("q"), _bucket(F.col("c")).alias("bucket")), "divergence-terms")
    of_terms = top_terms(terms, k).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.col("f").alias("value"))
    of_pairs = pairs(terms, groups).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.col("f").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return of_terms.unionByName(of_pairs).withColumn("rank", rank)


#: The same rows by DuckDB.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (
  SELECT no, lang, source, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS l FROM t GROUP BY lang, term HAVING count(DISTINCT no) >= 10
), vocabulary AS (
  SELECT lang, count(*) AS v, sum(l) AS nl FROM kept GROUP BY lang
), c AS (
  SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY t.lang, t.source, t.term
), n AS (
  SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source
), g AS (
  SELECT DISTINCT d.lang, d.source, coalesce(n.n, 0) AS n, coalesce(v.v, 0) AS v, v.nl
  FROM d LEFT JOIN n ON n.lang = d.lang AND n.source = d.source LEFT JOIN vocabulary v ON v.lang = d.lang
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (g.n + 2 * g.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.l + 2)) // (g.nl + 2 * g.v)::HUGEINT AS q
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), items AS (
  SELECT a.lang, a.source, 'term' AS part, a.term AS item, ((a.p - a.q) * (a.p - a.q)) // (a.p + a.q) AS value FROM p a WHERE a.c > 0 AND a.p > a.q
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM items
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
