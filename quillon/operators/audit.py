"""Audit logs: hash chains, statistics, access rules; agent health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.operators.ranges import running
from quillon.plans.fixtures import audit_log, bus_messages


def entry_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by bars; null parts are empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def details_text(details: Column) -> Column:
    """A map as key=value pairs in order of the keys, joined by semicolons."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(details)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def content_hash(log: DataFrame) -> DataFrame:
    """log with entry_hash over its own fields."""
    return log.withColumn("entry_hash", entry_hash(F.col("sequence_number"), F.col("actor_id"), F.col("action"), F.col("details")))


def broken_links(log: DataFrame, segment: int = 100_000) -> DataFrame:
    """Entries whose previous_hash is not the entry before them's hash.

    The order is by sequence number; numbers are dealt in segments with the entry before each segment's first, so no
    single task orders the whole log.
    """
    copies = F.when(F.col("sequence_number") % segment == segment - 1, F.array(F.floor(F.col("sequence_number") / segment), F.floor(F.col("sequence_number") / segment) + 1)).otherwise(F.array(F.floor(F.col("sequence_number") / segment)))
    dealt = log.withColumn("segment", F.explode(copies))
    w = Window.partitionBy("segment").orderBy("sequence_number")
    linked = dealt.withColumn("expected", F.lag("entry_hash").over(w)).where(F.floor(F.col("sequence_number") / segment) == F.col("segment"))
    return linked.where(F.col("expected").isNotNull() & ~F.col("previous_hash").eqNullSafe(F.col("expected"))).drop("segment")


@query("win07_hash_chain", "WITH h AS (SELECT sequence_number, sha256(concat_ws('|', cast(sequence_number as varchar), cast(actor_id as varchar), action, details)) AS h FROM audit_log) SELECT sequence_number, h AS entry_hash, lag(h) OVER (ORDER BY sequence_number) AS previous_hash FROM h")
def win07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with the hash of the one before it: a join on the number before, so no task orders the whole log."""
    h = content_hash(audit_log(spark, sf_dir)).select("sequence_number", "entry_hash")
    before = h.select((F.col("sequence_number") + 1).alias("sequence_number"), F.col("entry_hash").alias("previous_hash"))
    return h.join(before, "sequence_number", "left")


@query("win07_verify", "SELECT 0::bigint AS broken")
def win07_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = win07(spark, sf_dir)
    return broken_links(log).agg(F.count("*").alias("broken"))


@query("agg34_audit_stats", "SELECT action, strftime(\"timestamp\", '%Y-%m-%d') AS day, count(*) AS n, min(sequence_number) AS first_seq, max(sequence_number) AS last_seq FROM audit_log GROUP BY GROUPING SETS ((action), (2))")
def agg34(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = audit_log(spark, sf_dir).select("action", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "sequence_number")
    return log.groupingSets([("action",), ("day",)], "action", "day").agg(F.count("*").alias("n"), F.min("sequence_number").alias("first_seq"), F.max("sequence_number").alias("last_seq")).select("action", "day", "n", "first_seq", "last_seq")


@query("agg35_count_by", "SELECT c_mktsegment AS role, c_nationkey AS org, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
def agg35(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_mktsegment").alias("role"), F.col("c_nationkey").alias("org"))
    return users.groupingSets([("role",), ("org",), ()], "role", "org").agg(F.count("*").alias("n")).select("role", "org", "n")


@query("agg44_health", "SELECT agent_id, count(*) AS tasks, round_even(count(*) FILTER (success) / count(*), 4) AS success_rate, round_even(count(*) FILTER (NOT success) / count(*), 4) AS failure_rate FROM bus_messages GROUP BY 1")
def agg44(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.count_if("success")
    return bus_messages(spark, sf_dir).groupBy("agent_id").agg(F.count("*").alias("tasks"), F.bround(ok / F.count("*"), 4).alias("success_rate"), F.bround((F.count("*") - ok) / F.count("*"), 4).alias("failure_rate"))


@query("agg49_bus_stats", "SELECT message_type, priority, count(*) AS n FROM bus_messages GROUP BY CUBE (message_type, priority)")
def agg49(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bus_messages(spark, sf_dir).cube("message_type", "priority").agg(F.count("*").alias("n"))


@query("win11_failures", "SELECT event_id, agent_id, CASE WHEN success THEN 0 ELSE row_number() OVER (PARTITION BY agent_id, g ORDER BY event_id) - CASE WHEN g > 0 THEN 1 ELSE 0 END END AS run FROM (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY agent_id ORDER BY event_id) AS g FROM bus_messages)")
def win11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive failures of an agent up to each task; a success starts anew."""
    rows = running(bus_messages(spark, sf_dir).select("event_id", "agent_id", "success"), "agent_id", ["event_id"], marks=("success",))
    run = F.col("row_no") - F.coalesce("mark_success", F.lit(0))
    return rows.select("event_id", "agent_id", F.when(F.col("success"), 0).otherwise(run).cast("long").alias("run"))


@query("sec21_permissions", "SELECT c_mktsegment AS role, array_to_string(list_sort(list(DISTINCT CASE c_nationkey % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'scan' WHEN 2 THEN 'triage' ELSE 'admin' END)), ',') AS permissions FROM customer WHERE c_acctbal < 500 GROUP BY 1")
def sec21(spark: SparkSession, sf_dir: str) -> DataFrame:
    permission = F.element_at(F.array(*map(F.lit, ("read", "scan", "triage", "admin"))), (F.col("c_nationkey") % 4 + 1).cast("int"))
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal < 500")
    return users.groupBy(F.col("c_mktsegment").alias("role")).agg(F.array_join(F.sort_array(F.collect_set(permission)), ",").alias("permissions"))
