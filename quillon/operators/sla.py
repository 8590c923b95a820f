"""Service-level deadlines: records, breaches, alerts, time to remediate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.plans.fixtures import DAYS, as_of, findings, pick, sla_records, sql_pick

#: Days before a deadline of the reminder and of the escalation.
REMIND = {"CRITICAL": 2, "HIGH": 3, "MEDIUM": 5, "LOW": 14}
ESCALATE = {"CRITICAL": 1, "HIGH": 2, "MEDIUM": 3, "LOW": 7}
CLOSED = ("remediated", "dismissed")


def seconds(later: Column, earlier: Column) -> Column:
    """Seconds between two times, at microsecond grain."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def is_open() -> Column:
    return ~F.col("status").isin(*CLOSED)


def days_remaining(now: Column) -> Column:
    """Whole days to the deadline, not below 0; 0 for closed records."""
    return F.when(is_open(), F.greatest(F.lit(0).cast("long"), F.floor(seconds(F.col("sla_deadline"), now) / 86400))).otherwise(0)


def hours_overdue(now: Column) -> Column:
    late = seconds(now, F.col("sla_deadline")) / 3600
    return F.when(is_open() & (late > 0), late).otherwise(0.0)


_NOW = "TIMESTAMP '2001-09-01'"
_OPEN = "status NOT IN ('remediated','dismissed')"
_LEFT = f"CASE WHEN {_OPEN} THEN greatest(0, cast(floor(epoch(sla_deadline - {_NOW}) / 86400) as bigint)) ELSE 0 END"


@query("scl23_sla_scalars", f"SELECT vulnerability_id, {_LEFT} AS days_remaining, round_even(CASE WHEN {_OPEN} AND {_NOW} > sla_deadline THEN epoch({_NOW} - sla_deadline) / 3600 ELSE 0 END, 4) AS hours_overdue FROM sla_records")
def scl23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sla_records(findings(spark, sf_dir)).select("vulnerability_id", days_remaining(as_of()).alias("days_remaining"), F.bround(hours_overdue(as_of()), 4).alias("hours_overdue"))


@query("jon05_sla_join", f"SELECT f.id, f.severity, coalesce(d.days, 30) AS days, f.detected_at + to_days(coalesce(d.days, 30)) AS deadline FROM findings f LEFT JOIN (VALUES {', '.join(f"('{s}', {d})" for s, d in DAYS.items() if s != 'INFO')}) d(severity, days) ON d.severity = f.severity")
def jon05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with their definition's days; 30 where there is no definition."""
    rules = spark.createDataFrame([(s, d) for s, d in DAYS.items() if s != "INFO"], "severity string, days int")
    days = F.coalesce("days", F.lit(30))
    return findings(spark, sf_dir).join(F.broadcast(rules), "severity", "left").select("id", "severity", days.alias("days"), (F.col("detected_at") + F.make_dt_interval(days)).alias("deadline"))


@query("agg15_mttr", "SELECT count(*) AS n, round_even(avg(time_to_remediate_hours), 4) AS mttr_hours, round_even(avg(time_to_remediate_hours) / 24, 4) AS mttr_days FROM sla_records WHERE status='remediated' AND time_to_remediate_hours IS NOT NULL")
def agg15(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = F.avg("time_to_remediate_hours")
    return sla_records(findings(spark, sf_dir)).where("status = 'remediated' AND time_to_remediate_hours IS NOT NULL").agg(F.count("*").alias("n"), F.bround(hours, 4).alias("mttr_hours"), F.bround(hours / 24, 4).alias("mttr_days"))


@query("agg16_mttr_rollup", "SELECT severity, count(*) AS n, round_even(avg(time_to_remediate_hours), 2) AS mttr, min(time_to_remediate_hours) AS fastest, max(time_to_remediate_hours) AS slowest FROM sla_records WHERE status='remediated' AND detected_at >= TIMESTAMP '1996-01-01' GROUP BY ROLLUP (severity)")
def agg16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sla_records(findings(spark, sf_dir)).where("status = 'remediated' AND detected_at >= TIMESTAMP_NTZ '1996-01-01'")
    t = "time_to_remediate_hours"
    return rows.rollup("severity").agg(F.count("*").alias("n"), F.bround(F.avg(t), 2).alias("mttr"), F.min(t).alias("fastest"), F.max(t).alias("slowest"))


@query("agg17_sla_dashboard", f"""SELECT severity, count(*) AS tracked, count(*) FILTER ({_OPEN}) AS open, count(*) FILTER ({_OPEN} AND {_NOW} > sla_deadline) AS breached, count(*) FILTER ({_OPEN} AND {_LEFT} <= 3) AS approaching,
round_even(count(*) FILTER (status='remediated' AND detected_at + to_hours(cast(time_to_remediate_hours as int)) <= sla_deadline) * 100.0 / count(*), 2) AS compliance_rate FROM sla_records GROUP BY severity""")
def agg17(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = (F.col("status") == "remediated") & (F.col("detected_at") + F.make_dt_interval(F.lit(0), F.col("time_to_remediate_hours").cast("int")) <= F.col("sla_deadline"))
    return sla_records(findings(spark, sf_dir)).groupBy("severity").agg(F.count("*").alias("tracked"), F.count_if(is_open()).alias("open"), F.count_if(is_open() & (as_of() > F.col("sla_deadline"))).alias("breached"), F.count_if(is_open() & (days_remaining(as_of()) <= 3)).alias("approaching"), F.bround(F.count_if(met) * 100.0 / F.count("*"), 2).alias("compliance_rate"))


def alerts(records: DataFrame, now: Column) -> DataFrame:
    """Alerts that are due: breach, escalation or reminder, by the days that the severity allows."""
    left = seconds(F.col("sla_deadline"), now) / 86400
    kind = F.when(left < 0, "breach").when(left <= pick(ESCALATE, F.col("severity"), 2), "escalation").when(left <= pick(REMIND, F.col("severity"), 5), "reminder")
    return records.where(is_open()).withColumn("alert_type", kind).where("alert_type IS NOT NULL")


@query("str07_sla_alerts", f"SELECT vulnerability_id, severity, CASE WHEN d < 0 THEN 'breach' WHEN d <= {sql_pick(ESCALATE, 'severity', 2)} THEN 'escalation' WHEN d <= {sql_pick(REMIND, 'severity', 5)} THEN 'reminder' END AS alert_type FROM (SELECT *, epoch(sla_deadline - {_NOW}) / 86400 AS d FROM sla_records WHERE {_OPEN}) WHERE alert_type IS NOT NULL")
def str07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts(sla_records(findings(spark, sf_dir)), as_of()).select("vulnerability_id", "severity", "alert_type")


@query("flt07_alerts_page", f"SELECT vulnerability_id, sla_deadline FROM sla_records WHERE {_OPEN} AND sla_deadline < {_NOW} ORDER BY sla_deadline DESC, vulnerability_id LIMIT 1000")
def flt07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts(sla_records(findings(spark, sf_dir)), as_of()).where("alert_type = 'breach'").orderBy(F.desc("sla_deadline"), "vulnerability_id").limit(1000).select("vulnerability_id", "sla_deadline")


@query("sec11_latest_state", "SELECT actor_id, arg_max(action, sequence_number) AS last_action, max(sequence_number) AS at FROM audit_log GROUP BY 1")
def sec11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each record from its log of mutations."""
    from quillon.plans.fixtures import audit_log

    return audit_log(spark, sf_dir).groupBy("actor_id").agg(F.max_by("action", "sequence_number").alias("last_action"), F.max("sequence_number").alias("at"))
