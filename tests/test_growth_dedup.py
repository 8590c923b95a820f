"""Work of the greedy groups that must not grow with the number of scans, and the best finding of each place."""

from __future__ import annotations

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from quillon.operators import dedup

TEXTS = [f"possible {k} found by {t} in src{a} {b}py" for k in ("sql injection", "code injection", "xss") for t in ("semgrep", "bandit") for a in ("old", "hot", "large") for b in ("bolt", "gear")]


def test_texts_of_many_scans_are_compared_once(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(f"{i:05}", f"s{i % 30}", rng.choice(["HIGH", "LOW"]), rng.choice(["HIGH", "INFO"]), t) for i, t in enumerate(rng.choice(TEXTS) for _ in range(900))]
    found = spark.createDataFrame(rows, "id string, scan_id string, confidence string, severity string, description string").cache()
    near, met = dedup._near, []
    monkeypatch.setattr(dedup, "_near", lambda nodes: (met.append((out := near(nodes)).count()), out)[1])
    got = {r.id: (r.lead, r.kept) for r in dedup.semantic_groups(found).collect()}
    assert 0 < sum(met) <= len(TEXTS) * (len(TEXTS) - 1) / 2

    n = found.select(dedup.normalised(F.col("description")).alias("n")).distinct()
    pairs = n.crossJoin(n.withColumnRenamed("n", "m")).where(dedup.semantic_similarity(F.col("n"), F.col("m")) >= 0.85)
    alike, want = {(r.n, r.m) for r in pairs.collect()}, {}
    for scan in sorted({r[1] for r in rows}):
        own, gone = [r for r in rows if r[1] == scan], set()
        for i, r in enumerate(own):
            if r[0] not in gone:
                group = [r] + [q for q in own[i + 1 :] if q[0] not in gone and (r[4], q[4]) in alike]
                gone |= {q[0] for q in group}
                best = max(group, key=lambda q: dedup.CONFIDENCE_POINTS[q[2]] + dedup.SEVERITY_POINTS[q[3]])
                want |= {q[0]: (r[0], q is best) for q in group}
    assert got == want
    assert len(alike) > len(TEXTS)


def test_edges_by_text_and_by_scan_are_the_same(spark):
    rng = random.Random(9)
    texts = TEXTS + ["xss", "xss a", " ".join(f"w{i}" for i in range(30)), " ".join(f"w{i}" for i in range(1, 31))]
    real = spark.createDataFrame([Row(scan_id=f"s{s}", n=t, k=rng.randrange(10**9)) for s in range(6) for t in texts if rng.random() < 0.7])
    numbered = real.select("n").distinct().withColumn("t", F.xxhash64("n")).cache()
    by_text, by_scan = (sorted(map(tuple, e.collect())) for e in (dedup._edges_by_text(real, numbered, 0.85), dedup._edges_by_scan(real, 0.85)))
    assert by_text == by_scan and len(by_text) > 20


def test_best_of_places_is_the_first_of_the_window(spark):
    rng = random.Random(10)
    # parts that make the same text count as one place
    places = [("a", 1, "X"), ("a:1", 2, "X"), ("a", 1, "2:X"), (None, 1, "X"), ("1", None, "X"), ("a", None, None)]
    rows = [(f"{rng.randrange(10**6)}-{i}", rng.choice("st"), *rng.choice(places), rng.choice(["HIGH", "MEDIUM", None]), rng.choice(["CRITICAL", "LOW"]), rng.choice(["bandit", "dast"])) for i in range(200)]
    found = spark.createDataFrame(rows, "id string, scan_id string, file_path string, line_number int, category string, severity string, confidence string, tool_source string")
    want = dedup.first_by(found.withColumn("h", dedup.dedup_hash()), ("scan_id", "h"), dedup.best_points().desc(), F.col("id")).withColumn("points", dedup.best_points())
    columns = ("scan_id", "id", "points", "category", "tool_source", "file_path")
    got = dedup.best_of_places(found).select(*columns).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want.select(*columns).collect())) and len(got) == 8
