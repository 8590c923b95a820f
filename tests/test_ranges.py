"""Running values over ranges against a plain loop; a hot group is many tasks."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillon.operators import ranges


def loop(rows):
    out, state = [], {}
    for g, o, v, ok in sorted(rows, key=lambda r: (r[0] is not None, str(r[0]), r[1])):
        s = state.setdefault(g, {"no": 0, "sum": 0, "previous": None, "mark": None})
        s["no"] += 1
        s["sum"] += v or 0
        if ok:
            s["mark"] = s["no"]
        out.append((g, o, s["no"], s["sum"], s["previous"], s["mark"]))
        s["previous"] = v
    return sorted(map(str, ((*r, state[r[0]]["no"]) for r in out)))


def test_running_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + ["b", "c", None]), i, rng.choice([None, 1, 5, -3]), rng.random() < 0.2) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, v int, ok boolean").repartition(7)
    got = ranges.running(df, "g", ["o"], ("v",), ("v",), ("ok",))
    assert sorted(str((r.g, r.o, r.row_no, r.sum_v, r.previous_v, r.mark_ok, r.group_rows)) for r in got.collect()) == loop(rows)
    assert ranges.running(df.limit(0), "g", ["o"], ("v",), ("v",), ("ok",)).count() == 0


def test_a_hot_group_is_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select(F.lit("hot").alias("g"), "id", (F.col("id") % 7).alias("v"))
        got = ranges.running(df, "g", ["id"], ("v",))
        assert got.agg(F.max("row_no"), F.max("sum_v")).first()[:] == (4000, sum(i % 7 for i in range(4000)))
        assert df.repartitionByRange("g", "id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ends(spark):
    rows = [("a", i, float(i)) for i in range(10)] + [("b", 0, 5.0)]
    got = {r.g: (r.n, r.first_mean, r.last_mean) for r in ranges.ends_of(spark.createDataFrame(rows, "g string, o int, v double"), "g", "v", 3, ["o"]).collect()}
    assert got == {"a": (10, 1.0, 8.0), "b": (1, None, None)}
