"""The domain's tables, derived from the driver's: findings, scans, SLA records, agent runs, audit log, bus messages.

Each is a DataFrame function; TABLES_SQL has the same rows as DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.tables import table

#: Severities from worst to least with their weight, rank, days to remediate and hours of effort.
SEVERITIES = (("CRITICAL", 25, 4, 7, 8.0), ("HIGH", 10, 3, 15, 4.0), ("MEDIUM", 4, 2, 30, 2.0), ("LOW", 1, 1, 90, 0.5), ("INFO", 0, 0, 30, 0.25))
WEIGHT = {s: w for s, w, *_ in SEVERITIES}
RANK = {s: r for s, _, r, *_ in SEVERITIES}
DAYS = {s: d for s, _, _, d, _ in SEVERITIES}
EFFORT = {s: e for s, *_, e in SEVERITIES}
CATEGORIES = ("SQL Injection", "XSS", "Code Injection", "Hardcoded Secret", "Path Traversal", "Weak Crypto", "CORS", "Vulnerable Dependency")
TOOLS = ("semgrep", "bandit", "custom_ai", "taint_analyzer", "dast_scanner", "gitleaks")
#: The CWE of each category.
CWES = {"SQL Injection": "CWE-89", "XSS": "CWE-79", "Code Injection": "CWE-94", "Hardcoded Secret": "CWE-798", "Path Traversal": "CWE-22", "Weak Crypto": "CWE-327", "CORS": "CWE-942", "Vulnerable Dependency": "CWE-1104"}
#: The moment that stands for "now".
AS_OF = "2001-09-01 00:00:00"


def as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF)).cast("timestamp_ntz")


def pick(values: dict[str, object], key: Column, default: object = None) -> Column:
    """The value of a key by a small fixed table."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out if default is None else out.otherwise(F.lit(default))


def sql_pick(values: dict[str, object], key: str, default: object = None) -> str:
    """The same as a CASE expression."""
    lit = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in values.items()) + (f" ELSE {lit(default)}" if default is not None else "") + " END"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding for each line item."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_discount", "l_shipdate", "l_linestatus", "l_tax")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    q = F.col("l_quantity")
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    of = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)
    return joined.select(
        F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).alias("id"),
        F.concat((F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("string"), F.lit("-"), (F.col("o_custkey") % 5).cast("string")).alias("scan_id"),
        F.concat(F.lit("project-"), (F.col("o_custkey") % 5).cast("string")).alias("repo"),
        F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".py")).alias("file_path"),
        F.col("l_linenumber").alias("line_number"),
        F.when(q >= 46, "CRITICAL").when(q >= 36, "HIGH").when(q >= 21, "MEDIUM").when(q >= 6, "LOW").otherwise("INFO").alias("severity"),
        of(CATEGORIES, F.col("l_partkey")).alias("category"),
        of(TOOLS, F.col("l_suppkey")).alias("tool_source"),
        F.when(F.col("l_returnflag") == "A", "HIGH").when(F.col("l_returnflag") == "R", "MEDIUM").otherwise("LOW").alias("confidence"),
        F.when(F.col("l_discount") > 0, F.col("l_discount") * 100).alias("cvss_score"),
        F.col("l_shipdate").alias("detected_at"), F.col("o_orderdate").alias("scan_time"), "l_linestatus", "l_tax", "l_quantity",
    )


def severity_counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(s.lower()) for s in WEIGHT]


def scans(found: DataFrame) -> DataFrame:
    """One scan for each scan_id of the findings."""
    place = F.concat("file_path", F.col("line_number").cast("string"))
    counts = found.groupBy("scan_id").agg(F.min("repo").alias("name"), F.min("scan_time").alias("start_time"), F.max("scan_time").alias("end_time"), F.count_distinct("file_path").alias("total_files"), (100 * F.count_distinct(place)).alias("total_lines"), F.count("*").alias("total"), *severity_counts())
    score = sum((F.col(s.lower()) * w for s, w in WEIGHT.items() if w), F.lit(0).cast("long"))
    return counts.withColumns({"status": F.lit("completed"), "raw_score": score})


def sla_records(found: DataFrame) -> DataFrame:
    """One SLA record for each finding."""
    status = F.when(F.col("l_linestatus") == "F", "remediated").when(F.col("l_tax") >= 0.07, "dismissed").when(F.col("confidence") == "HIGH", "in_progress").when(F.col("confidence") == "MEDIUM", "assigned").otherwise("open")
    days = pick(DAYS, F.col("severity"), 30)
    return found.select(F.col("id").alias("vulnerability_id"), "scan_id", "severity", "category", "detected_at", (F.col("detected_at") + F.make_dt_interval(days)).alias("sla_deadline"), status.alias("status"), F.when(F.col("l_linestatus") == "F", F.col("l_quantity") * 12.0).alias("time_to_remediate_hours"))


def agent_runs(found: DataFrame) -> DataFrame:
    return found.groupBy("scan_id", F.col("tool_source").alias("agent_name")).agg(F.count("*").alias("findings_count"), (10 * F.count_distinct("file_path")).alias("duration_ms"))


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("sequence_number"), F.col("user_id").alias("actor_id"), F.col("event_type").alias("action"), F.col("props").alias("details"), F.col("ts").alias("timestamp"))


def bus_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 8).alias("agent_id"), (F.col("event_id") % 5 + 1).alias("priority"), F.col("event_type").alias("message_type"), (F.col("event_type") != "error").alias("success"), "value")


_FINDINGS = f"""SELECT concat_ws('-', cast(l_orderkey as varchar), cast(l_linenumber as varchar), cast(l_partkey as varchar), cast(l_suppkey as varchar), cast(l_extendedprice as varchar)) AS id,
  concat(cast(year(o_orderdate)*100+month(o_orderdate) as varchar), '-', cast(o_custkey % 5 as varchar)) AS scan_id, concat('project-', cast(o_custkey % 5 as varchar)) AS repo,
  concat('src/', replace(p_name,' ','_'), '.py') AS file_path, l_linenumber AS line_number,
  CASE WHEN l_quantity>=46 THEN 'CRITICAL' WHEN l_quantity>=36 THEN 'HIGH' WHEN l_quantity>=21 THEN 'MEDIUM' WHEN l_quantity>=6 THEN 'LOW' ELSE 'INFO' END AS severity,
  ({list(CATEGORIES)})[l_partkey % 8 + 1] AS category, ({list(TOOLS)})[l_suppkey % 6 + 1] AS tool_source,
  CASE l_returnflag WHEN 'A' THEN 'HIGH' WHEN 'R' THEN 'MEDIUM' ELSE 'LOW' END AS confidence, CASE WHEN l_discount > 0 THEN l_discount*100 END AS cvss_score,
  l_shipdate AS detected_at, o_orderdate AS scan_time, l_linestatus, l_tax, l_quantity
FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey"""
_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in WEIGHT)
#: DuckDB text of each derived table.
TABLES_SQL = {
    "findings": _FINDINGS,
    "scans": f"SELECT scan_id, min(repo) AS name, min(scan_time) AS start_time, max(scan_time) AS end_time, count(DISTINCT file_path) AS total_files, 100*count(DISTINCT concat(file_path, cast(line_number as varchar))) AS total_lines, count(*) AS total, {_COUNTS}, 'completed' AS status, cast(sum({sql_pick(WEIGHT, 'severity')}) as bigint) AS raw_score FROM findings GROUP BY scan_id",
    "sla_records": f"SELECT id AS vulnerability_id, scan_id, severity, category, detected_at, detected_at + to_days({sql_pick(DAYS, 'severity', 30)}) AS sla_deadline, CASE WHEN l_linestatus='F' THEN 'remediated' WHEN l_tax >= 0.07 THEN 'dismissed' WHEN confidence='HIGH' THEN 'in_progress' WHEN confidence='MEDIUM' THEN 'assigned' ELSE 'open' END AS status, CASE WHEN l_linestatus='F' THEN l_quantity*12.0 END AS time_to_remediate_hours FROM findings",
    "agent_runs": "SELECT scan_id, tool_source AS agent_name, count(*) AS findings_count, 10*count(DISTINCT file_path) AS duration_ms FROM findings GROUP BY scan_id, tool_source",
    "audit_log": "SELECT event_id AS sequence_number, user_id AS actor_id, event_type AS action, props AS details, ts AS \"timestamp\" FROM events",
    "bus_messages": "SELECT event_id, ts, user_id % 8 AS agent_id, event_id % 5 + 1 AS priority, event_type AS message_type, event_type <> 'error' AS success, value FROM events",
    "deduped": f"SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY scan_id, file_path, line_number, category ORDER BY {sql_pick(RANK, 'severity')} DESC, id) = 1",
}
