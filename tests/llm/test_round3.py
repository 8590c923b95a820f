"""Source divergence, hard negatives and sharding against brute force and by their laws."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import divergence, hard_negatives, sharding

DOCS = "doc_id long, text string, lang string, source string"


# -- 11: source divergence


def brute_audit(rows, least=10, k=10):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        found = [t.translate(lower) for t in term.findall(text or "")]
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out, f = [], lambda p, q: (p - q) ** 2 // (p + q)
    for lang in docs:
        kept = {t for t, n in docs[lang].items() if n >= least}
        v, own = len(kept), {s: c for (x, s), c in groups.items() if x == lang}
        whole = sum((Counter({t: n for t, n in c.items() if t in kept}) for c in own.values()), Counter())
        p = lambda c, t, kept=kept, v=v: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * v)
        for s, c in own.items():
            pairs = [(sum(f(p(c, t), p(d, t)) for t in kept), o) for o, d in own.items() if o != s]
            terms = [(f(p(c, t), p(whole, t)), t) for t in kept if c[t] > 0 and p(c, t) > p(whole, t)]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, k)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def source_rows():
    rng = random.Random(5)
    common = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Ärger", "ÄRGER", "中文"]
    rows = []
    for i in range(400):
        source = rng.choice(["hot", "hot", "hot", "b", "c", None])
        own = [f"{source}own{chr(97 + j)}" for j in range(8)]
        rows.append((i, " ".join(rng.choice(common if rng.random() < 0.8 else own) for _ in range(rng.randint(1, 60))), rng.choice(["en", "en", "de", None]), source))
    rows += [(900, None, "en", "empty"), (901, "", None, None), (902, "12 34 !!", "fr", "x"), (903, "few words here", "fr", "y"), (904, "only one", "it", "z"), (None, "worta " * 5000, "en", "b")]
    return rows + rows[:30]  # repeated rows


def test_source_divergence(spark):
    rows = source_rows()
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("term", "c", "p", "n", "v", "bucket")})
    got = divergence.audit(df.repartition(5))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows)
    assert divergence.audit(df.limit(0)).count() == 0


def test_source_divergence_chunks_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 40)
    monkeypatch.setattr(divergence, "STEP", 1)
    monkeypatch.setattr(divergence, "HELD", 2000)
    monkeypatch.setattr(divergence, "PIECE", 150)
    rows = source_rows()
    got = divergence.audit(spark.createDataFrame(rows, DOCS), least_docs=3, k=4)
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows, 3, 4)


def test_upper_bounds_spare_buckets(spark, sf_dir):
    kept, groups = divergence.postings(spark.read.parquet(f"{sf_dir}/documents.parquet"), least_docs=2)
    sized = divergence._with_groups(kept, groups, F.xxhash64("term"))
    p = lambda c, n: divergence.probability(F.col(c), F.col(n), F.col("v"))
    terms = sized.select("lang", "source", "term", p("c", "n").alias("p"), p("l", "nl").alias("q"), divergence._bucket(F.col("c")).alias("bucket"))
    work = []
    divergence.top_terms(terms, 1, work)
    assert work[0][0] < work[0][1]


def test_buckets_of_counts(spark):
    values = [*range(1, 70), 127, 128, 1 << 20, (1 << 62) + 5]
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "c long").select(divergence._bucket(F.col("c")).alias("b")).collect()]
    assert got == sorted(got) and got[:16] == list(range(1, 17)) and got[16] == 16 and got[17] == 17


def test_probability_is_exact_at_any_size(spark):
    cases = [(7 * 10**11, 16 * 10**12, 10**9), (0, 0, 1), (3, 10, 4), (9 * 10**17, 9 * 10**17, 5)]
    got = spark.createDataFrame(cases, "c long, n long, v long").select(divergence.probability(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in cases]


# -- 12: hard negatives


def brute_mined(rows, positives=5, k=3):
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a in {i: (i, v, y) for i, v, y in sorted(ok, reverse=True)}.values():
        if a[0] % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(a[1], v)), i, y) for i, v, y in ok if i != a[0] and len(v) == len(a[1]))
        for place, (s, i, _) in enumerate([x for x in scored if x[2] == a[2]][:positives], 1):
            near = [x for x in scored if x[2] != a[2] and 50 * -s <= 100 * -x[0] <= 95 * -s][:k]
            out += [(a[0], place, i, rank, x[1], -s, -x[0]) for rank, x in enumerate(near, 1)]
    return sorted(out)


def vector_rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 16)) / 3
    rows = [(i, [float(x) for x in centres[i % 4] + rng.normal(size=16) / 8], int(i % 5)) for i in range(400)]
    rows += [(i, rows[8][1], 2) for i in range(400, 420)] + rows[:20]  # ties and repeated rows
    return rows + [(450, None, 1), (500, [None] * 16, 1), (550, [float("inf")] * 16, 1), (600, [0.0] * 16, 0), (650, [], 1), (651, [], 2), (652, [], 1), (700, [0.3] * 3, 1), (750, rows[3][1], None), (None, rows[3][1], 1)]


def test_hard_negatives(spark, monkeypatch):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("vec_id", "label", hard_negatives.grid(F.col("embedding")).alias("vector"), F.lit(1).alias("id"), F.lit(2).alias("score"))
    anchors = df.where("vec_id % 50 = 0")
    want = brute_mined(rows)
    assert want and sorted(tuple(r) for r in hard_negatives.mine(df, anchors).collect()) == want
    monkeypatch.setattr(hard_negatives, "BYTES", 8 * 18 * 100)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 3)
    assert sorted(tuple(r) for r in hard_negatives.mine(df, anchors).collect()) == want
    assert hard_negatives.mine(df.limit(0), anchors).count() == hard_negatives.mine(df, anchors.limit(0)).count() == 0


def test_ranges_at_their_edges():
    scores = np.array([100, 96, 95, 95, 80, 50, 49, 0, -3])
    assert scores[hard_negatives.in_range(scores, 100, 3, 50, 95)].tolist() == [95, 95, 80]
    assert scores[hard_negatives.in_range(scores, 100, 9, 50, 95)].tolist() == [95, 95, 80, 50]
    assert scores[hard_negatives.in_range(scores, 0, 3, 50, 95)].tolist() == [0]
    assert scores[hard_negatives.in_range(scores, -10, 3, 50, 95)].tolist() == []
    for positive in range(-40, 41):
        s = np.arange(60, -61, -1)
        want = [x for x in s.tolist() if 50 * positive <= 100 * x <= 95 * positive][:3]
        assert s[hard_negatives.in_range(s, positive, 3, 50, 95)].tolist() == want


def test_inner_products_of_large_components():
    for top in (10, 1 << 26, 1 << 30):
        rng = np.random.default_rng(top)
        a, b = rng.integers(-top, top, (5, 7)), rng.integers(-top, top, (6, 7))
        assert hard_negatives.inner_products(a, b).tolist() == (a.astype(object) @ b.T.astype(object)).tolist()


# -- 13: sharding


def test_permutation_and_its_inverse():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        p = sharding.permuted(np.arange(n), n)
        assert sorted(p.tolist()) == list(range(n))
        assert sharding.permuted(p, n, back=True).tolist() == list(range(n))
        assert n < 100 or sharding.permuted(np.arange(n), n, seed=14).tolist() != p.tolist()
        for row in {0, n // 2, n - 1}:
            assert sharding.row_at(*sharding.place(row, n), n) == row
    big = 10**13 + 7
    rows = np.array([0, 1, 12345678901, big - 1])
    assert sharding.permuted(sharding.permuted(rows, big), big, back=True).tolist() == rows.tolist()


def test_permutation_mixes():
    n = 48_000
    p = sharding.permuted(np.arange(n), n)
    shard = p % 24
    for part in (shard[:4800], shard[::10]):  # rows near each other and at equal distances go everywhere
        counts = np.bincount(part, minlength=24)
        assert ((counts - 200.0) ** 2 / 200).sum() < 60
    assert abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.02


def shard_rows(df):
    return sorted((str(r.doc_id), str(r.text), r.shard, r.slot) for r in df.select("doc_id", "text", "shard", "slot").collect())


def test_sharding(spark, tmp_path):
    rows = [(i if i % 7 else None, "hot" if i % 3 == 0 else f"text {i} é", "en", None) for i in range(500)] + [(3, "twice", "en", "a"), (3, "twice", "de", "a"), (3, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"slot": F.lit(-1), "at": F.lit(-1), "part": F.lit("x"), "first": F.lit(1), "r": F.lit(2), "k": F.lit(3)})
    out = sharding.sharded(df.repartition(6))
    assert set(out.columns) == {*df.columns, "shard"}
    found = out.collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in found) == sorted((str(r[0]), str(r[1])) for r in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert shard_rows(sharding.sharded(df.coalesce(1))) == shard_rows(out) != shard_rows(sharding.sharded(df, seed=2))
    # a row's place follows from its number alone
    numbers, n = sharding.numbered(df.drop("slot"))
    assert n == len(rows) and sorted(r.row_no for r in numbers.collect()) == list(range(n))
    assert {(r.doc_id, r.text, r.lang, *sharding.place(r.row_no, n)) for r in numbers.collect()} >= {(r.doc_id, r.text, r.lang, r.shard, r.slot) for r in found if r.doc_id is not None}
    sharding.write_shards(out, f"{tmp_path}/shards", 10)
    again = spark.read.parquet(f"{tmp_path}/shards")
    assert shard_rows(again) == shard_rows(out)
    assert {p.name for p in tmp_path.joinpath("shards").glob("shard=*/file=*")} == {"file=0", "file=1", "file=2"}
    assert sharding.sharded(df.limit(0)).count() == 0 and len(sharding.sharded(df.limit(5)).collect()) == 5


def test_equal_rows_are_no_single_partition(spark, monkeypatch):
    largest = []
    write = sharding.written

    def spied(rows, name):
        out = write(rows, name)
        largest.append(out.groupBy(F.shiftright("at", 33)).count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(sharding, "written", spied)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
        numbers, n = sharding.numbered(df.repartition(8))
        assert n == 4000 and numbers.select(F.count_distinct("row_no")).first()[0] == 4000
        assert largest[0] < 2500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
