"""Triage: confidence, severity adjustment, status, cross-reference fold, fix queue, agent selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.plans.fixtures import RANK, findings, pick, sql_pick

#: Base confidence; bonuses and penalties in points; order of severities.
BASE = {"HIGH": 80.0, "MEDIUM": 50.0, "LOW": 20.0}
TAINT, DAST, FALSE_POSITIVE, TEST_FILE, AGREEMENT = 15.0, 10.0, 30.0, 20.0, 0.2
ORDER = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
TEST_PATH = r"test|spec|mock|fixture|example"


def confidence_score(agents: Column) -> Column:
    """0 to 100: base, times agreement, plus taint and dynamic bonuses, minus the penalty of a test file."""
    score = pick(BASE, F.col("confidence"), 50.0)
    score = F.when(agents > 1, score * (1 + AGREEMENT * (agents - 1))).otherwise(score)
    score = score + F.when(F.col("tool_source") == "taint_analyzer", TAINT).otherwise(0.0) + F.when(F.col("tool_source") == "dast_scanner", DAST).otherwise(0.0)
    score = score - F.when(F.lower("file_path").rlike(TEST_PATH), TEST_FILE).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def escalated(severity: Column, steps: Column | int = 1) -> Column:
    """The severity so many steps up, CRITICAL at most; unknown ones count as LOW."""
    at = pick({s: i for i, s in enumerate(ORDER)}, severity, 1)
    return F.element_at(F.array(*map(F.lit, ORDER)), F.least(at + steps, F.lit(4)).cast("int") + 1)


def adjusted_severity(reachable: Column) -> Column:
    """Exploitation first, then a sensitive context for injections, then reachability, each on the previous result."""
    injection = F.lower("category").isin("sql injection", "command injection", "code injection", "xss")
    sensitive = F.lower("file_path").rlike("admin|login|auth|payment|secret|token|sso")
    one = F.when(injection & sensitive, escalated(F.col("severity"))).otherwise(F.col("severity"))
    return F.when(reachable, escalated(one)).otherwise(one)


def status(score: Column) -> Column:
    return F.when(score >= 80, "confirmed").when(score >= 50, "likely_true_positive").otherwise("uncertain")


def triaged(found: DataFrame) -> DataFrame:
    """Findings with agents (that report the same place), score, status and adjusted severity."""
    agents = found.groupBy("scan_id", "file_path", "line_number").agg(F.count_distinct("tool_source").alias("agents"))
    both = found.join(agents, ["scan_id", "file_path", "line_number"])
    both = both.withColumn("score", confidence_score(F.col("agents")))
    return both.withColumns({"status": status(F.col("score")), "adjusted": adjusted_severity(F.col("tool_source") == "taint_analyzer")})


_TRIAGED = f"""SELECT *, CASE WHEN score >= 80 THEN 'confirmed' WHEN score >= 50 THEN 'likely_true_positive' ELSE 'uncertain' END AS status FROM (SELECT f.*, a.agents,
 greatest(0, least(100, ({sql_pick(BASE, 'confidence', 50.0)})::double * CASE WHEN agents > 1 THEN 1 + 0.2::double * (agents - 1) ELSE 1 END + CASE tool_source WHEN 'taint_analyzer' THEN 15 WHEN 'dast_scanner' THEN 10 ELSE 0 END - CASE WHEN regexp_matches(lower(file_path), '{TEST_PATH}') THEN 20 ELSE 0 END)) AS score
 FROM findings f JOIN (SELECT scan_id, file_path, line_number, count(DISTINCT tool_source) AS agents FROM findings GROUP BY 1,2,3) a USING (scan_id, file_path, line_number))"""


@query("scl14_confidence", f"SELECT id, agents, round_even(score, 4) AS score, status FROM ({_TRIAGED})")
def scl14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triaged(findings(spark, sf_dir)).select("id", "agents", F.bround("score", 4).alias("score"), "status")


_UP = "CASE severity WHEN 'INFO' THEN 'LOW' WHEN 'LOW' THEN 'MEDIUM' WHEN 'MEDIUM' THEN 'HIGH' ELSE 'CRITICAL' END"


@query("scl15_adjusted", f"WITH a AS (SELECT id, tool_source, CASE WHEN lower(category) IN ('sql injection','code injection','xss') AND regexp_matches(lower(file_path), 'admin|login|auth|payment|secret|token|sso') THEN {_UP} ELSE severity END AS severity FROM findings) SELECT id, CASE WHEN tool_source='taint_analyzer' THEN {_UP} ELSE severity END AS adjusted FROM a")
def scl15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("id", adjusted_severity(F.col("tool_source") == "taint_analyzer").alias("adjusted"))


@query("srt02_triaged", f"SELECT id, row_number() OVER (PARTITION BY scan_id ORDER BY {sql_pick(RANK, 'severity')} DESC, score DESC, id) AS place FROM ({_TRIAGED})")
def srt02(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("scan_id").orderBy(pick(RANK, F.col("severity")).desc(), F.desc("score"), "id")
    return triaged(findings(spark, sf_dir)).select("id", F.row_number().over(w).cast("long").alias("place"))


def cross_reference(found: DataFrame) -> DataFrame:
    """The findings of a place folded in order of id: correlated agents, confidence ladder, escalated severity.

    The first is the primary; each further one is appended; one makes HIGH, two CONFIRMED; once a static and a dynamic
    tool have met it is EXPLOITABLE, and every further match escalates the severity by a step.
    """
    static, dynamic = F.array(*map(F.lit, ("semgrep", "bandit", "custom_ai", "taint_analyzer"))), F.lit("dast_scanner")
    grouped = found.groupBy("scan_id", "file_path", "line_number", F.lower("category").alias("category")).agg(F.array_sort(F.collect_list(F.struct("id", "tool_source", "severity"))).alias("g"))
    start = F.struct(F.element_at("g", 1)["severity"].alias("severity"), F.array(F.element_at("g", 1)["tool_source"]).alias("tools"), F.lit("LOW").alias("confidence"))

    def fold(state: Column, x: Column) -> Column:
        tools = F.concat(state["tools"], F.array(x["tool_source"]))
        both = F.arrays_overlap(tools, static) & F.array_contains(tools, dynamic)
        worst = F.when(pick(RANK, x["severity"]) > pick(RANK, state["severity"]), x["severity"]).otherwise(state["severity"])
        level = F.when(both, "EXPLOITABLE").when(F.size(tools) > 2, "CONFIRMED").otherwise("HIGH")
        return F.struct(F.when(both, escalated(worst)).otherwise(worst).alias("severity"), tools.alias("tools"), level.alias("confidence"))

    folded = grouped.withColumn("s", F.aggregate(F.slice("g", 2, F.greatest(F.size("g") - 1, F.lit(0))), start, fold))
    return folded.select("scan_id", "file_path", "line_number", "category", F.element_at("g", 1)["id"].alias("primary_id"), F.array_join("s.tools", ",").alias("tools"), "s.confidence", "s.severity")


@query("agg24_cross_reference")
def agg24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_reference(findings(spark, sf_dir))


@query("scl35_adaptive", "SELECT scan_id, bool_or(category='Hardcoded Secret') AS secrets, bool_or(category='SQL Injection') AS sqli, count(*) FILTER (category='Code Injection' AND severity <> 'CRITICAL') AS escalated FROM findings GROUP BY 1")
def scl35(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy("scan_id").agg(F.bool_or(F.col("category") == "Hardcoded Secret").alias("secrets"), F.bool_or(F.col("category") == "SQL Injection").alias("sqli"), F.count_if((F.col("category") == "Code Injection") & (F.col("severity") != "CRITICAL")).alias("escalated"))


@query("scl37_approval", "SELECT scan_id, count(*) AS needs_approval FROM findings WHERE severity='CRITICAL' AND confidence='HIGH' GROUP BY 1")
def scl37(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).where("severity = 'CRITICAL' AND confidence = 'HIGH'").groupBy("scan_id").agg(F.count("*").alias("needs_approval"))


#: Points of a fix by severity and confidence, order of categories.
FIX_SEVERITY = {"CRITICAL": 100, "HIGH": 75, "MEDIUM": 50, "LOW": 25, "INFO": 10}
FIX_CONFIDENCE = {"HIGH": 15, "MEDIUM": 5, "LOW": -10}
FIX_ORDER = {"Hardcoded Secret": 1, "SQL Injection": 2, "Code Injection": 3, "XSS": 4, "Path Traversal": 5}


@query("sec01_fix_queue", f"SELECT id, o AS fix_order, p AS points, row_number() OVER (PARTITION BY scan_id ORDER BY o, p DESC, id) AS place FROM (SELECT *, {sql_pick(FIX_ORDER, 'category', 99)} AS o, {sql_pick(FIX_SEVERITY, 'severity')} + {sql_pick(FIX_CONFIDENCE, 'confidence')} AS p FROM findings)")
def sec01(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = findings(spark, sf_dir).select("id", "scan_id", pick(FIX_ORDER, F.col("category"), 99).alias("fix_order"), (pick(FIX_SEVERITY, F.col("severity")) + pick(FIX_CONFIDENCE, F.col("confidence"))).alias("points"))
    return q.select("id", "fix_order", "points", F.row_number().over(Window.partitionBy("scan_id").orderBy("fix_order", F.desc("points"), "id")).cast("long").alias("place"))


@query("sec02_fix_batches", f"SELECT scan_id, file_path, array_to_string(list(id ORDER BY {sql_pick(FIX_ORDER, 'category', 99)}, id), ',') AS batch FROM findings GROUP BY 1, 2")
def sec02(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(pick(FIX_ORDER, F.col("category"), 99).alias("o"), "id")
    return findings(spark, sf_dir).groupBy("scan_id", "file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["id"]), ",").alias("batch"))


@query("agg48_agent_selection", "SELECT category, arg_min(tool_source, (n, tool_source)) AS agent, min(n) AS load FROM (SELECT category, tool_source, count(*) AS n FROM findings GROUP BY 1, 2) GROUP BY 1")
def agg48(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agent of least load for each role, ties by name."""
    load = findings(spark, sf_dir).groupBy("category", "tool_source").agg(F.count("*").alias("n"))
    return load.groupBy("category").agg(F.min_by("tool_source", F.struct("n", "tool_source")).alias("agent"), F.min("n").alias("load"))
