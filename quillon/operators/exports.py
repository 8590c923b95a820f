"""Exports: SARIF, JUnit, JSON, CEF, syslog, SBOM, Markdown; upserts and deletes as rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.operators.dedup import first_by
from quillon.plans.fixtures import findings, pick, scans, sql_pick
from quillon.sources.tables import table

#: SARIF levels, SIEM severities of a finding, syslog facility.
SARIF_LEVEL = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "none"}
SIEM_SEVERITY = {"CRITICAL": 10, "HIGH": 8, "MEDIUM": 5, "LOW": 2, "INFO": 1}
FACILITY = 16
VENDOR, PRODUCT, VERSION = "Quillon", "Quillon", "1.0"


def sarif_results(found: DataFrame) -> DataFrame:
    """scan_id and one SARIF result object for each finding; rules are numbered by first appearance within a scan."""
    w = Window.partitionBy("scan_id", "category")
    first = found.withColumn("first_id", F.min("id").over(w))
    ranked = first.withColumn("rule_index", F.dense_rank().over(Window.partitionBy("scan_id").orderBy("first_id")) - 1)
    where = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_number").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("category").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), pick(SARIF_LEVEL, F.col("severity"), "warning").alias("level"), F.struct(F.concat_ws(" in ", "category", "file_path").alias("text")).alias("message"), F.array(where).alias("locations"))
    return ranked.select("scan_id", "id", "rule_index", result.alias("result"))


def sarif(found: DataFrame) -> DataFrame:
    """scan_id and its SARIF 2.1.0 document, one row. A scan too large for a row (2 GB) is exported by sarif_results(), a row for each finding."""
    results = sarif_results(found).groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "result"))), lambda x: x["result"]).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit(PRODUCT).alias("name"), F.lit(VERSION).alias("version")).alias("driver")).alias("tool"), F.col("results"))
    return results.select("scan_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def junit(found: DataFrame) -> DataFrame:
    """scan_id and its JUnit document: one test case for each finding, failures for high severities, the others skipped."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    bad = F.col("severity").isin("CRITICAL", "HIGH", "MEDIUM")
    case = F.format_string('<testcase classname="%s" name="%s">%s</testcase>', escape(F.replace("file_path", F.lit("/"), F.lit("."))), escape(F.concat_ws(":", "category", F.col("line_number").cast("string"))), F.when(bad, F.format_string('<failure type="%s"/>', "severity")).otherwise("<skipped/>"))
    rows = found.select("scan_id", "id", bad.alias("bad"), case.alias("case"))
    g = rows.groupBy("scan_id").agg(F.count("*").alias("n"), F.count_if("bad").alias("f"), F.transform(F.array_sort(F.collect_list(F.struct("id", "case"))), lambda x: x["case"]).alias("cases"))
    return g.select("scan_id", F.format_string('<testsuite name="%s" tests="%d" failures="%d" skipped="%d">%s</testsuite>', "scan_id", "n", "f", F.col("n") - F.col("f"), F.array_join("cases", "")).alias("junit"))


def clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def cef(kind: Column, message: Column, severity: Column, extension: Column) -> Column:
    return F.concat_ws("|", F.lit("CEF:0"), F.lit(VENDOR), F.lit(PRODUCT), F.lit(VERSION), kind, message, clamp(severity, 0, 10).cast("string"), extension)


def syslog_priority(severity: Column, facility: int = FACILITY) -> Column:
    return facility * 8 + clamp(10 - severity, 0, 7)


def upserted(old: DataFrame, new: DataFrame, key: str, created: str, updated: str) -> DataFrame:
    """old with the rows of new put in by key: the newest wins and keeps the oldest creation time."""
    both = old.unionByName(new)
    w = Window.partitionBy(key)
    return first_by(both.withColumn(created, F.min(created).over(w)), (key,), F.desc(updated))


@query("snk05_sarif_rules", "SELECT scan_id, id, dense_rank() OVER (PARTITION BY scan_id ORDER BY f) - 1 AS rule_index FROM (SELECT scan_id, id, min(id) OVER (PARTITION BY scan_id, category) AS f FROM findings)")
def snk05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sarif_results(findings(spark, sf_dir)).select("scan_id", "id", F.col("rule_index").cast("long").alias("rule_index"))


@query("snk05_sarif_documents")
def snk05_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sarif(findings(spark, sf_dir)).select("scan_id", F.length("sarif").alias("length"), F.sha2("sarif", 256).alias("sarif_sha256"))


@query("snk05_levels", f"SELECT scan_id, {sql_pick(SARIF_LEVEL, 'severity', 'warning')} AS level, count(*) AS n, count(DISTINCT file_path) AS artifacts FROM findings GROUP BY 1, 2")
def snk05_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy("scan_id", pick(SARIF_LEVEL, F.col("severity"), "warning").alias("level")).agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("artifacts"))


@query("snk06_junit", """SELECT scan_id, md5('<testsuite name="' || scan_id || '" tests="' || count(*) || '" failures="' || count(*) FILTER (bad) || '" skipped="' || count(*) FILTER (NOT bad) || '">' || string_agg('<testcase classname="' || replace(file_path, '/', '.') || '" name="' || category || ':' || line_number || '">' || CASE WHEN bad THEN '<failure type="' || severity || '"/>' ELSE '<skipped/>' END || '</testcase>', '' ORDER BY id) || '</testsuite>') AS junit_md5
FROM (SELECT *, severity IN ('CRITICAL','HIGH','MEDIUM') AS bad FROM findings) GROUP BY scan_id""")
def snk06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return junit(findings(spark, sf_dir)).select("scan_id", F.md5("junit").alias("junit_md5"))


@query("snk07_json_summary", "SELECT scan_id, '{\"scan_id\":\"' || scan_id || '\",\"total\":' || total || ',\"critical\":' || critical || '}' AS json FROM scans")
def snk07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans(findings(spark, sf_dir)).select("scan_id", F.to_json(F.struct("scan_id", "total", "critical")).alias("json"))


@query("snk10_syslog", f"SELECT id, 128 + least(7, greatest(0, 10 - {sql_pick(SIEM_SEVERITY, 'severity', 5)})) AS pri FROM findings")
def snk10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("id", syslog_priority(pick(SIEM_SEVERITY, F.col("severity"), 5)).alias("pri"))


@query("snk11_cef", f"SELECT 'CEF:0|Quillon|Quillon|1.0|scan|' || scan_id || '|' || least(10, greatest(1, least(100, raw_score) // 10)) || '|total=' || total AS line FROM scans UNION ALL SELECT 'CEF:0|Quillon|Quillon|1.0|finding|' || category || '|' || {sql_pick(SIEM_SEVERITY, 'severity', 5)} || '|id=' || id FROM findings WHERE severity = 'CRITICAL'")
def snk11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(spark, sf_dir)
    score = clamp(F.floor(F.least(F.lit(100).cast("long"), "raw_score") / 10), 1, 10)
    of_scans = scans(found).select(cef(F.lit("scan"), F.col("scan_id"), score, F.concat(F.lit("total="), F.col("total").cast("string"))).alias("line"))
    of_findings = found.where("severity = 'CRITICAL'").select(cef(F.lit("finding"), F.col("category"), pick(SIEM_SEVERITY, F.col("severity"), 5), F.concat(F.lit("id="), "id")).alias("line"))
    return of_scans.unionByName(of_findings)


@query("snk12_sbom", "SELECT p_brand AS document, count(*) AS components, array_to_string(list(p_name || '@' || p_size ORDER BY p_name, p_size, p_partkey), ',') AS packages FROM part GROUP BY 1")
def snk12(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    name = F.concat_ws("@", "p_name", F.col("p_size").cast("string"))
    rows = part.groupBy(F.col("p_brand").alias("document")).agg(F.count("*").alias("components"), F.array_sort(F.collect_list(F.struct("p_name", "p_size", "p_partkey", name.alias("v")))).alias("p"))
    return rows.select("document", "components", F.array_join(F.transform("p", lambda x: x["v"]), ",").alias("packages"))


@query("snk01_upsert", "SELECT l_orderkey AS scan_id, min(l_shipdate) AS created_at, max(l_shipdate) AS updated_at FROM lineitem GROUP BY 1")
def snk01(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan_id"), F.col("l_shipdate").alias("created_at"), F.col("l_shipdate").alias("updated_at"), "l_linenumber")
    out = upserted(line.where("l_linenumber <= 3").drop("l_linenumber"), line.where("l_linenumber > 3").drop("l_linenumber"), "scan_id", "created_at", "updated_at")
    return out.select("scan_id", "created_at", "updated_at")


@query("snk03_delete", "SELECT repo, count(*) AS n FROM findings WHERE scan_id NOT IN (SELECT scan_id FROM scans WHERE raw_score > 1000) GROUP BY 1")
def snk03(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(spark, sf_dir)
    gone = scans(found).where("raw_score > 1000").select("scan_id")
    return found.join(gone, "scan_id", "left_anti").groupBy("repo").agg(F.count("*").alias("n"))


@query("snk04_status", "SELECT o_orderkey AS scan_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, CASE WHEN o_orderstatus IN ('F', 'P') THEN TIMESTAMP '2001-09-01' END AS end_time, CASE WHEN o_orderstatus IN ('F', 'P') THEN cast(epoch(TIMESTAMP '2001-09-01' - o_orderdate) as bigint) END AS duration FROM orders")
def snk04(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators.sla import seconds
    from quillon.plans.fixtures import as_of

    o = table(spark, sf_dir, "orders")
    status = pick({"F": "completed", "O": "running"}, F.col("o_orderstatus"), "failed")
    ended = status.isin("completed", "failed")
    return o.select(F.col("o_orderkey").alias("scan_id"), status.alias("status"), F.when(ended, as_of()).alias("end_time"), F.when(ended, seconds(as_of(), F.col("o_orderdate")).cast("long")).alias("duration"))


@query("snk13_bounded_log", "SELECT event_id, agent_id FROM bus_messages QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY event_id DESC) <= 50")
def snk13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.plans.fixtures import bus_messages

    k = F.row_number().over(Window.partitionBy("agent_id").orderBy(F.desc("event_id")))
    return bus_messages(spark, sf_dir).select("event_id", "agent_id", k.alias("k")).where("k <= 50").drop("k")


@query("snk16_markdown", "SELECT repo, string_agg('| ' || category || ' | ' || n || ' |', chr(10) ORDER BY n DESC, category) AS markdown FROM (SELECT repo, category, count(*) AS n FROM findings GROUP BY 1, 2) GROUP BY 1")
def snk16(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = findings(spark, sf_dir).groupBy("repo", "category").agg(F.count("*").alias("n"))
    line = F.format_string("| %s | %d |", "category", "n")
    g = counts.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "category", line.alias("line")))).alias("l"))
    return g.select("repo", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("markdown"))
