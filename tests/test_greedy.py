"""Greedy groups in rounds against the sequential pass."""

from __future__ import annotations

import random

import pytest

from quillon.operators import dedup


def sequential(pairs):
    later, lead = {}, {}
    for g, x, y in pairs:
        later.setdefault((g, x), set()).add(y)
    for g, x in sorted({(g, n) for g, a, b in pairs for n in (a, b)}):
        if (g, x) not in lead:
            for y in sorted(later.get((g, x), ())):
                lead.setdefault((g, y), x)
    return sorted((g, y, x) for (g, y), x in lead.items())


@pytest.mark.parametrize(("nodes", "edges"), [(30, 40), (60, 400), (400, 500)])
def test_random_graphs(spark, nodes, edges):
    rng = random.Random(nodes)
    pairs = sorted({(rng.choice("ab"), *sorted(rng.sample(range(nodes), 2))) for _ in range(edges)})
    got = dedup.greedy_leads(spark.createDataFrame(pairs + pairs[:5], "g string, x int, y int"), "g")
    assert sorted(tuple(r) for r in got.collect()) == sequential(pairs)


def test_paths_stars_and_nothing(spark):
    path = [("p", i, i + 1) for i in range(9)] + [("s", 0, i) for i in range(1, 50)] + [("t", i, 50) for i in range(50)]
    got = dedup.greedy_leads(spark.createDataFrame(path, "g string, x int, y int"), "g")
    assert sorted(tuple(r) for r in got.collect()) == sequential(path)
    assert dedup.greedy_leads(spark.createDataFrame([], "g string, x int, y int"), "g").count() == 0


def test_texts_that_differ_in_few_words_do_not_all_meet(spark):
    kinds, tools, places = ("sql injection", "xss", "weak crypto", "cors"), ("semgrep", "bandit", "gitleaks", "dast"), [f"{a} {b}" for a in ("srcold", "srcnew", "srchot", "srcred") for b in ("boltpy", "ringpy", "gearpy", "platepy")]
    texts = [f"possible {k} found by {t} in {p}" for k in kinds for t in tools for p in places]
    nodes = spark.createDataFrame([("s", t, t) for t in texts], "scan_id string, n string, first string")
    assert dedup._near(nodes).count() < len(texts) * 8


def test_pairs_of_all_lengths_against_all_pairs(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    texts = set()
    for size in (1, 2, 3, 4, 5, 7, 8, 9, 12, 17, 18, 19, 23, 24, 25, 26, 33, 40):
        words = [f"word{rng.randrange(60)}" for _ in range(size)]
        texts.add(" ".join(words))
        for _ in range(6):
            other = [w if rng.random() > 1.2 / size else w + rng.choice("abc") for w in words]
            texts.add(" ".join(other + ["more"] * rng.randrange(2) if rng.random() < 0.5 else other[:-1] or other))
            texts.add(" ".join(rng.sample(words, size)))
    df = spark.createDataFrame([("s", t) for t in sorted(texts)], "scan_id string, description string")
    a, b = df.select(F.col("description").alias("a")), df.select(F.col("description").alias("b"))
    want = a.join(b, F.col("a") < F.col("b")).where(dedup.semantic_similarity(F.col("a"), F.col("b")) >= 0.85)
    got = dedup.semantic_pairs(df).select("a", "b")
    assert want.count() > 100
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
