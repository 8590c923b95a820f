"""Timers against a replay of all rows in order, whatever the micro-batches, and after a restart."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillon.sources.shared import shared_path
from quillon.streaming import timers

HOUR = 3_600_000
START = 1_700_000_000_000


def beats():
    rng, rows = random.Random(4), []
    for key in range(6):
        now = START + rng.randrange(HOUR)
        for _ in range(40):
            now += rng.choice([HOUR // 4, HOUR, 5 * HOUR, 6 * HOUR, 7 * HOUR, 20 * HOUR])
            rows.append((key, now))
    rows.append((9, max(t for _, t in rows) + 1000 * HOUR))  # moves the watermark past everything else
    return sorted(rows, key=lambda r: r[1]) + rows[:3]


def replayed(rows, step, due=None):
    mark, out = max(t for _, t in rows) - 10 * HOUR, []
    for key in {k for k, _ in rows}:
        last, said = timers._NONE, False
        for t in sorted({t for k, t in rows if k == key and t < mark}):
            last, said, more = step(last, said, t)
            out += [(key, *m) for m in more]
        if due and last != timers._NONE and last + due < mark:
            out.append((key, "silent", last + due))
    return sorted(out)


def streamed(spark, rows, pieces, make, stop_after=None):
    """The stream over files of a few rows each, one a micro-batch, the rows at most 9 hours out of order."""
    rng = random.Random(pieces)
    rows = sorted(rows[:-3], key=lambda r: r[1] + rng.randrange(9 * HOUR)) + rows[-3:]
    rows = [*rows[-3:], *rows[:-3]] if pieces > 1 else rows
    to = shared_path(spark, "timers-test")
    size = -(-len(rows) // pieces)
    for i in range(0, len(rows), size):
        part = spark.createDataFrame(rows[i : i + size], "agent_id int, ms long").select("agent_id", F.timestamp_millis("ms").alias("ts"))
        part.coalesce(1).write.mode("append").parquet(f"{to}/in")

    def once():
        stream = spark.readStream.schema("agent_id int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{to}/in")
        running = make(stream).writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        running.awaitTermination()

    once()
    once()  # a restart from the checkpoint says nothing twice
    return sorted((r.agent_id, r.kind, round(r.at.timestamp() * 1000)) for r in spark.read.parquet(f"{to}/out").withColumn("at", F.col("at").cast("timestamp")).collect())


def test_silences_whatever_the_batches(spark):
    rows = beats()
    want = replayed(rows, timers.silence_step, timers.SILENT)
    assert {k for _, k, _ in want} == {"silent", "back"}
    for pieces in (1, 5):
        assert streamed(spark, rows, pieces, lambda s: timers.silences(s, late="10 hours")) == want


def test_alerts_are_not_repeated_within_a_day(spark):
    rows = beats()
    want = replayed(rows, timers.alert_step)
    assert 10 < len(want) < len(rows)
    assert streamed(spark, rows, 4, lambda s: timers.alerts(s, "agent_id", "10 hours")) == want


def test_steps():
    assert timers.silence_step(timers._NONE, False, 5) == (5, False, [])
    assert timers.silence_step(0, False, timers.SILENT) == (timers.SILENT, False, [])
    assert timers.silence_step(0, False, timers.SILENT + 1)[2] == [("silent", timers.SILENT), ("back", timers.SILENT + 1)]
    assert timers.silence_step(0, True, 7)[2] == [("back", 7)]
    assert timers.alert_step(0, False, timers.AGAIN - 1) == (0, False, []) and timers.alert_step(0, False, timers.AGAIN)[2]


def test_late_rows_are_counted(spark):
    to = shared_path(spark, "windows-test")
    for i, hours in enumerate(([0, 1, 30], [2, 29, 31], [0, 60])):
        rows = [(START + h * HOUR, "a", 1.0) for h in hours]
        spark.createDataFrame(rows, "ms long, event_type string, value double").select(F.timestamp_millis("ms").alias("ts"), "event_type", "value").coalesce(1).write.mode("append").parquet(f"{to}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(f"{to}/in")
    closed, late = timers.closed_windows(stream)
    rows = closed.collect()
    assert late >= 1 and len({r.start for r in rows}) == len(rows) and sum(r.n for r in rows) + late == 7  # all but the last window, which is open
