"""Streams over the events table, run to the end of their input, and their windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.plans.fixtures import bus_messages
from quillon.sources.shared import shared_path
from quillon.sources.tables import table
from quillon.streaming.state import breaker_stream, chain_stream, delivery_stream, limiter_stream


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, with ts as a timestamp (the session's zone is UTC)."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows of a stream once its present input is used up, from files that its micro-batches have written.

    A batch that runs again replaces its own folder. In complete mode the last batch has the whole result.
    """
    spark, to = stream.sparkSession, shared_path(stream.sparkSession, "stream")
    batches: list[int] = []

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{to}/rows/{batch}")
        batches.append(batch)

    running = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{to}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    running.awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    wanted = batches[-1:] if mode == "complete" else sorted(set(batches))
    return spark.read.schema(stream.schema).parquet(*(f"{to}/rows/{b}" for b in wanted))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and their value by type and window; later than the watermark are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.bround(F.sum("value"), 2).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("str12_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def str12_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(tumbling(event_stream(spark, sf_dir)), "complete").drop("total")


@query("str12_sliding", "SELECT ts_start AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS ts_start FROM events) GROUP BY 1")
def str12_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = event_stream(spark, sf_dir).groupBy(F.window("ts", "24 hours", "12 hours")).agg(F.count("*").alias("n"))
    return finished(w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n"), "complete")


@query("str12_session", """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def str12_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("str01_dispatch", "SELECT event_id, priority FROM bus_messages WHERE message_type = 'purchase'")
def str01(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_stream(spark, sf_dir).where("event_type = 'purchase'")
    return finished(s.select("event_id", (F.col("event_id") % 5 + 1).alias("priority")))


@query("str02_circuit_breaker")
def str02(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_stream(spark, sf_dir).select("event_id", (F.col("user_id") % 8).alias("agent_id"), "ts", (F.col("event_type") != "error").alias("success"))
    return finished(breaker_stream(s))


def deliveries(events: DataFrame) -> DataFrame:
    """Events as deliveries to eight endpoints; the outcomes of an event's three attempts follow from its number."""
    n = F.col("event_id")
    outcomes = F.array(n % 3 == 0, n % 5 == 0, n % 7 == 0)
    return events.select("event_id", (F.col("user_id") % 8).alias("endpoint"), "ts", outcomes.alias("outcomes"))


@query("str03_delivery_breaker")
def str03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivery breaker's state after every event of its endpoint."""
    return finished(delivery_stream(deliveries(event_stream(spark, sf_dir)))).select("event_id", "endpoint", "breaker")


@query("str04_retries")
def str04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is logged of every delivery with retries."""
    return finished(delivery_stream(deliveries(event_stream(spark, sf_dir)))).select("event_id", "endpoint", "status", "attempt")


@query("str11_hash_chain", """WITH RECURSIVE e AS (SELECT user_id % 8 AS chain, event_id AS sequence, event_type AS record, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS k FROM events),
c AS (SELECT chain, sequence, k, repeat('0', 64) AS previous_hash, sha256(repeat('0', 64) || '|' || record) AS entry_hash FROM e WHERE k = 1 UNION ALL SELECT e.chain, e.sequence, e.k, c.entry_hash, sha256(c.entry_hash || '|' || e.record) FROM c JOIN e ON e.chain = c.chain AND e.k = c.k + 1)
SELECT chain, sequence, previous_hash, entry_hash FROM c""")
def str11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records appended to eight hash chains."""
    return finished(chain_stream(event_stream(spark, sf_dir).select((F.col("user_id") % 8).alias("chain"), F.col("event_id").alias("sequence"), F.col("event_type").alias("record"))))


@query("str06_rate_limit")
def str06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(limiter_stream(event_stream(spark, sf_dir).select("event_id", F.col("user_id").alias("identity"), "ts")))


@query("str05_heartbeat", "SELECT user_id AS agent_id, CASE WHEN s > 60 * 3600 THEN 'unhealthy' WHEN s > 30 * 3600 THEN 'degraded' ELSE 'healthy' END AS status FROM (SELECT user_id, epoch((SELECT max(ts) FROM events) - max(ts)) AS s FROM events GROUP BY 1)")
def str05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents' status by their silence (here in hours), as of the last event."""
    events = table(spark, sf_dir, "events")
    last = events.groupBy(F.col("user_id").alias("agent_id")).agg(F.max("ts").alias("ts")).crossJoin(F.broadcast(events.agg(F.max("ts").alias("now"))))
    silent = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9
    return last.select("agent_id", F.when(silent > 60, "unhealthy").when(silent > 30, "degraded").otherwise("healthy").alias("status"))


@query("str08_latest_progress", "SELECT agent_id, arg_max(message_type, event_id) AS latest, max(event_id) AS at FROM bus_messages GROUP BY 1")
def str08(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_stream(spark, sf_dir).groupBy((F.col("user_id") % 8).alias("agent_id")).agg(F.max_by("event_type", "event_id").alias("latest"), F.max("event_id").alias("at"))
    return finished(s, "complete")


@query("str09_bounded_history", "SELECT agent_id, event_id FROM bus_messages QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY event_id DESC) <= 10")
def str09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten messages of each agent."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("agent_id").orderBy(F.desc("event_id")))
    return bus_messages(spark, sf_dir).select("agent_id", "event_id", k.alias("k")).where("k <= 10").drop("k")


@query("str10_job_states", "SELECT user_id AS job_id, CASE arg_max(event_type, event_id) WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'running' END AS state FROM events GROUP BY 1")
def str10(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.max_by("event_type", "event_id").alias("e"))
    return last.select("job_id", F.when(F.col("e") == "purchase", "done").when(F.col("e") == "error", "failed").when(F.col("e") == "signup", "pending").otherwise("running").alias("state"))
