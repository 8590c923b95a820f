"""Streams with event-time timers: agents that fall silent, alerts that are not repeated within a day, windows that close.

Keyed rows are held until the watermark has passed them and are then taken in order of time, so what comes out does not
depend on how the rows were dealt into micro-batches, as long as none is later than the watermark allows. A key's state is
what it still holds (bounded by the watermark's delay) and a few numbers; a timer wakes it when something falls due. Times
are milliseconds; something is due at a time when the watermark is past it.

Cases: rows with a null key or time are left out; equal rows count as one; a stream without rows has no results; rows later
than the watermark are dropped by the stream, and counted by closed_windows().
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.catalog import query
from quillon.sources.shared import shared_path
from quillon.streaming.queries import event_stream, finished

#: Silence after which an agent is reported; time within which an alert is not repeated (milliseconds).
SILENT, AGAIN = 6 * 3_600_000, 24 * 3_600_000
_NONE = -(1 << 62)

#: What a key does with a row (its state, last time and whether something is reported; the row's time) and when it is due.
Step = Callable[[int, bool, int], tuple[int, bool, list[tuple[str, int]]]]


def silence_step(last: int, silent: bool, now: int, most: int = SILENT) -> tuple[int, bool, list[tuple[str, int]]]:
    """A sign of life: what falls due before it, and its own effect."""
    out = [("silent", last + most)] if last != _NONE and not silent and last + most < now else []
    return now, False, out + ([("back", now)] if silent or out else [])


def alert_step(last: int, _: bool, now: int, again: int = AGAIN) -> tuple[int, bool, list[tuple[str, int]]]:
    """A breach that is seen: an alert unless there was one within a day."""
    return (now, False, [("alert", now)]) if last == _NONE or now - last >= again else (last, False, [])


def in_order(stream: DataFrame, key: str, step: Step, due: int | None = None, due_name: str = "") -> DataFrame:
    """key, kind and at of what step() says of a stream's rows (key, ts) in order of time; with due, due_name is said that long after the last row unless another comes."""
    types = dict(stream.dtypes)

    def run(name: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, said, held = state.get if state.exists else (_NONE, False, [])
        held = {*held, *(int(t.value // 1_000_000) for b in batches for t in b["ts"])}
        mark, out = state.getCurrentWatermarkMs(), []
        for now in sorted(t for t in held if t < mark):
            last, said, more = step(last, said, now)
            out += more
        if due is not None and last != _NONE and not said and last + due < mark:
            said = True
            out.append((due_name, last + due))
        held = sorted(t for t in held if t >= mark)
        state.update((last, said, held))
        wake = [*held[:1], *([last + due] if due is not None and last != _NONE and not said else [])]
        if wake:
            state.setTimeoutTimestamp(max(min(wake), mark + 1))
        if out:
            yield pd.DataFrame({key: [name[0]] * len(out), "kind": [k for k, _ in out], "at": pd.to_datetime([t for _, t in out], unit="ms", utc=True)})

    rows = stream.select(key, "ts").where(F.col(key).isNotNull() & F.col("ts").isNotNull())
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {types[key]}, kind string, at timestamp", "last long, said boolean, held array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def silences(beats: DataFrame, key: str = "agent_id", late: str = "1 hour", most: int = SILENT) -> DataFrame:
    """An agent is ``silent`` when its last sign of life is longer ago than most, and ``back`` with the next one."""
    return in_order(beats.withWatermark("ts", late), key, lambda a, b, c: silence_step(a, b, c, most), most, "silent")


def alerts(breaches: DataFrame, key: str = "record_id", late: str = "1 hour", again: int = AGAIN) -> DataFrame:
    """One alert for a breach that goes on, and another one when it is still seen a day after the last."""
    return in_order(breaches.withWatermark("ts", late), key, lambda a, b, c: alert_step(a, b, c, again))


def closed_windows(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> tuple[DataFrame, int]:
    """start, event_type, n and total of the windows that the watermark has closed, each written once, and how many rows came too late. State holds open windows only."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.bround(F.sum("value"), 2).alias("total"))
    stream = w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
    spark, to = stream.sparkSession, shared_path(stream.sparkSession, "closed")
    running = stream.writeStream.format("parquet").option("path", f"{to}/rows").option("checkpointLocation", f"{to}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in running.recentProgress for s in p["stateOperators"])
    return spark.read.schema(stream.schema).parquet(f"{to}/rows"), dropped


#: The watermark when all events are in, an hour behind the last; parts of a millisecond do not count.
_MARK = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)"
_BEATS = f"SELECT DISTINCT user_id % 40 AS agent_id, date_trunc('millisecond', ts) AS ts FROM events WHERE event_type = 'click' AND date_trunc('millisecond', ts) < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events WHERE event_type = 'click')"


@query("str05_silences", f"WITH b AS (SELECT agent_id, ts, lead(ts) OVER (PARTITION BY agent_id ORDER BY ts) AS next FROM ({_BEATS})), m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS mark FROM events WHERE event_type = 'click') SELECT agent_id, 'silent' AS kind, ts + INTERVAL 6 HOUR AS \"at\" FROM b, m WHERE (next IS NULL OR ts + INTERVAL 6 HOUR < next) AND ts + INTERVAL 6 HOUR < mark UNION ALL SELECT agent_id, 'back', next FROM b WHERE ts + INTERVAL 6 HOUR < next")
def str05_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents that fall silent for six hours and come back, as a stream with timers."""
    beats = event_stream(spark, sf_dir).where("event_type = 'click'").select((F.col("user_id") % 40).alias("agent_id"), "ts")
    return finished(silences(beats)).withColumn("at", F.col("at").cast("timestamp_ntz"))


_SEEN = "SELECT DISTINCT user_id % 25 AS record_id, date_trunc('millisecond', ts) AS ts FROM events WHERE event_type = 'error' AND date_trunc('millisecond', ts) < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events WHERE event_type = 'error')"


@query("str07_alerts", f"WITH RECURSIVE b AS ({_SEEN}), a AS (SELECT record_id, min(ts) AS \"at\" FROM b GROUP BY 1 UNION ALL SELECT b.record_id, min(b.ts) FROM a JOIN b ON b.record_id = a.record_id AND b.ts >= a.\"at\" + INTERVAL 24 HOUR GROUP BY b.record_id, a.\"at\") SELECT record_id, 'alert' AS kind, \"at\" FROM a")
def str07_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of breaches that go on, at most one a day for each record, remembered across micro-batches."""
    seen = event_stream(spark, sf_dir).where("event_type = 'error'").select((F.col("user_id") % 25).alias("record_id"), "ts")
    return finished(alerts(seen)).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("str12_closed_windows", f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, any_value(ts)) + INTERVAL 1 HOUR <= {_MARK}")
def str12_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows in append mode: each is written once, when the watermark has passed its end."""
    return closed_windows(event_stream(spark, sf_dir))[0].drop("total")
