"""Joins of findings with dimensions, controls, feedback, functions and grants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.operators.risk import EPSS, KEV, with_threat
from quillon.plans.fixtures import CWES, findings, pick, scans, sla_records, sql_pick
from quillon.sources.tables import table

#: Categories that each control looks at.
CONTROLS = {"A.8.24": ("Weak Crypto",), "A.8.26": ("SQL Injection", "XSS", "Code Injection"), "A.8.28": ("Path Traversal", "CORS"), "A.5.17": ("Hardcoded Secret",), "A.8.8": ("Vulnerable Dependency",), "A.8.99": ("Race Condition",)}
_CWE = sql_pick(CWES, "category")


def controls(spark: SparkSession) -> DataFrame:
    """One row for each control and category."""
    return spark.createDataFrame([(c, k) for c, ks in CONTROLS.items() for k in ks], "control string, category string")


_CONTROLS = ", ".join(f"('{c}', '{k}')" for c, ks in CONTROLS.items() for k in ks)


@query("jon01_epss", f"SELECT id, coalesce(({sql_pick(EPSS, 'cwe_id')})::double, 0) AS epss FROM (SELECT id, {_CWE} AS cwe_id FROM findings)")
def jon01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_threat(findings(spark, sf_dir)).select("id", "epss")


@query("jon02_kev", f"SELECT scan_id, count(*) FILTER (cwe_id IN {KEV}) AS known_exploited, count(*) AS n FROM (SELECT scan_id, {_CWE} AS cwe_id FROM findings) GROUP BY 1")
def jon02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_threat(findings(spark, sf_dir)).groupBy("scan_id").agg(F.count_if("kev").alias("known_exploited"), F.count("*").alias("n"))


@query("jon03_last_alias", "SELECT l_orderkey AS record, arg_max(p_name, (l_linenumber, l_suppkey, l_partkey)) AS last_name FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def jon03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases looked up one by one; the last one wins."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("record")).agg(F.max_by("p_name", F.struct("l_linenumber", "l_suppkey", "l_partkey")).alias("last_name"))


@query("jon04_advisories", "SELECT p_name AS package, p_brand AS ecosystem, count(*) AS hits FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size > 40 GROUP BY 1, 2")
def jon04(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where("p_size > 40").select("p_partkey", F.col("p_name").alias("package"), F.col("p_brand").alias("ecosystem"))
    return part.join(table(spark, sf_dir, "lineitem").select("l_partkey"), F.col("p_partkey") == F.col("l_partkey")).groupBy("package", "ecosystem").agg(F.count("*").alias("hits"))


@query("jon06_team_theta", """WITH t(team, scan_prefix, project) AS (VALUES ('web', '199501', 'project-1'), ('core', '199712', 'project-2'), ('infra', '1800', 'none')),
m AS (SELECT DISTINCT team, scan_id FROM t JOIN scans ON starts_with(scan_id, scan_prefix) OR name = project) SELECT t.team, count(m.scan_id) AS scans FROM t LEFT JOIN m ON m.team = t.team GROUP BY 1""")
def jon06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams and scans by either of two keys: the union of two equi-joins, so no nested loop over the scans."""
    teams = spark.createDataFrame([("web", "199501", "project-1"), ("core", "199712", "project-2"), ("infra", "1800", "none")], "team string, prefix string, project string")
    s = scans(findings(spark, sf_dir)).select("scan_id", "name", F.split_part("scan_id", F.lit("-"), F.lit(1)).alias("month"))
    both = teams.join(s, F.col("prefix") == F.col("month")).select("team", "scan_id").unionByName(teams.join(s, F.col("project") == F.col("name")).select("team", "scan_id")).distinct()
    return teams.join(both, "team", "left").groupBy("team").agg(F.count("scan_id").alias("scans"))


@query("jon08_rules", "WITH r(rule, kind, least) AS (VALUES ('block-critical', 'critical', 1), ('max-high', 'high', 30), ('max-total', 'total', 150)) SELECT scan_id, rule, CASE kind WHEN 'critical' THEN critical WHEN 'high' THEN high ELSE total END >= least AS violated FROM scans CROSS JOIN r")
def jon08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules against scans: findings are aggregated to one row a scan first, the rules are a literal of the plan."""
    s = scans(findings(spark, sf_dir))
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(k).alias("kind"), F.lit(x).alias("least")) for n, k, x in (("block-critical", "critical", 1), ("max-high", "high", 30), ("max-total", "total", 150))))
    each = s.withColumn("r", F.explode(rules)).select("scan_id", "r.*", "critical", "high", "total")
    value = F.when(F.col("kind") == "critical", F.col("critical")).when(F.col("kind") == "high", F.col("high")).otherwise(F.col("total"))
    return each.select("scan_id", "rule", (value >= F.col("least")).alias("violated"))


@query("jon09_semi", f"SELECT id, severity FROM findings WHERE category IN (SELECT category FROM (VALUES {_CONTROLS}) c(control, category) WHERE control = 'A.8.26')")
def jon09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).join(F.broadcast(controls(spark).where("control = 'A.8.26'")), "category", "left_semi").select("id", "severity")


@query("jon10_controls", f"SELECT scan_id, control, bool_or(hit) AS failed FROM (SELECT DISTINCT s.scan_id, c.control, f.category IS NOT NULL AS hit FROM (SELECT DISTINCT scan_id FROM findings) s CROSS JOIN (VALUES {_CONTROLS}) c(control, category) LEFT JOIN (SELECT DISTINCT scan_id, category FROM findings) f ON f.scan_id = s.scan_id AND f.category = c.category) GROUP BY 1, 2")
def jon10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a scan has findings of a control's categories: sets of categories first, then a small literal."""
    sets = findings(spark, sf_dir).groupBy("scan_id").agg(F.collect_set("category").alias("categories"))
    each = F.array(*(F.struct(F.lit(c).alias("control"), F.array(*map(F.lit, ks)).alias("wants")) for c, ks in CONTROLS.items()))
    return sets.withColumn("c", F.explode(each)).select("scan_id", "c.control", F.arrays_overlap("categories", "c.wants").alias("failed"))


@query("agg36_compliance", f"WITH j AS (SELECT c.control, count(f.id) AS findings, count(f.id) FILTER (f.severity IN ('CRITICAL','HIGH')) AS severe FROM (VALUES {_CONTROLS}) c(control, category) LEFT JOIN findings f ON f.category = c.category GROUP BY 1) SELECT control, findings, severe, CASE WHEN findings = 0 THEN 'compliant' WHEN severe = 0 THEN 'partial' ELSE 'non_compliant' END AS status FROM j")
def agg36(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence and status of each control; findings are counted by category before the join."""
    counts = findings(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("severity").isin("CRITICAL", "HIGH")).alias("s"))
    j = controls(spark).join(counts, "category", "left").groupBy("control").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("findings"), F.coalesce(F.sum("s"), F.lit(0)).alias("severe"))
    return j.select("control", "findings", "severe", F.when(F.col("findings") == 0, "compliant").when(F.col("severe") == 0, "partial").otherwise("non_compliant").alias("status"))


@query("agg38_framework_pct", f"SELECT round_even(avg(CASE WHEN n = 0 THEN 100.0::double ELSE 0 END), 4) AS compliance_pct, count(*) AS controls FROM (SELECT c.control, count(f.id) AS n FROM (VALUES {_CONTROLS}) c(control, category) LEFT JOIN findings f ON f.category = c.category GROUP BY 1)")
def agg38(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg36(spark, sf_dir).agg(F.bround(F.avg(F.when(F.col("findings") == 0, 100.0).otherwise(0.0)), 4).alias("compliance_pct"), F.count("*").alias("controls"))


@query("agg40_policy_eval", "SELECT name, count(*) AS scans, count(*) FILTER (critical >= 1) AS failed, count(*) FILTER (critical = 0 AND high >= 10) AS warned, count(*) FILTER (critical = 0 AND high < 10) AS passed, CASE WHEN count(*) FILTER (critical >= 1) > 0 THEN 2 WHEN count(*) FILTER (high >= 10) > 0 THEN 1 ELSE 0 END AS exit_code FROM scans GROUP BY 1")
def agg40(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed, warned = F.col("critical") >= 1, F.col("high") >= 10
    code = F.when(F.count_if(failed) > 0, 2).when(F.count_if(warned) > 0, 1).otherwise(0)
    return scans(findings(spark, sf_dir)).groupBy("name").agg(F.count("*").alias("scans"), F.count_if(failed).alias("failed"), F.count_if(~failed & warned).alias("warned"), F.count_if(~failed & ~warned).alias("passed"), code.alias("exit_code"))


@query("jon11_chain_members", "SELECT f.id, c.nodes FROM findings f JOIN (SELECT repo, file_path, count(*) AS nodes FROM findings WHERE severity = 'CRITICAL' GROUP BY 1, 2) c ON c.repo = f.repo AND c.file_path = f.file_path WHERE f.severity = 'CRITICAL'")
def jon11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with their chain's size: one window instead of an aggregate and a join."""
    return findings(spark, sf_dir).where("severity = 'CRITICAL'").select("id", F.count("*").over(Window.partitionBy("repo", "file_path")).alias("nodes"))


@query("jon13_feedback", "SELECT count(DISTINCT d.doc_id) AS known, d.lang AS category FROM documents d JOIN (SELECT lang, md5(text) AS h FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) t ON t.lang = d.lang AND t.h = md5(d.text) GROUP BY 2")
def jon13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose category and text were judged false positives before."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("h"))
    judged = docs.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id").select("lang", "h").distinct()
    return docs.join(judged, ["lang", "h"], "left_semi").groupBy(F.col("lang").alias("category")).agg(F.count_distinct("doc_id").alias("known"))


BIN = 5


@query("jon15_range", "SELECT u.file_path, u.line_number, f.start, f.stop FROM (SELECT DISTINCT file_path, line_number FROM findings WHERE severity = 'INFO') u JOIN (SELECT file_path, min(line_number) AS start, max(line_number) AS stop FROM findings WHERE severity = 'CRITICAL' GROUP BY file_path, category) f ON f.file_path = u.file_path AND u.line_number BETWEEN f.start AND f.stop")
def jon15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines inside ranges of the same file: both are dealt by file and bin of lines, so it is an equi-join."""
    found = findings(spark, sf_dir)
    lines = found.where("severity = 'INFO'").select("file_path", "line_number").distinct().withColumn("bin", F.floor(F.col("line_number") / BIN))
    ranges = found.where("severity = 'CRITICAL'").groupBy("file_path", "category").agg(F.min("line_number").alias("start"), F.max("line_number").alias("stop")).select("file_path", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor(F.col("stop") / BIN))).alias("bin"))
    return lines.join(ranges, ["file_path", "bin"]).where("line_number BETWEEN start AND stop").select("file_path", "line_number", "start", "stop")


@query("jon16_anti", "SELECT DISTINCT file_path FROM findings f WHERE severity = 'INFO' AND NOT EXISTS (SELECT 1 FROM findings g WHERE g.file_path = f.file_path AND g.severity = 'CRITICAL' AND g.confidence = 'HIGH' AND g.tool_source = 'bandit' AND g.category = 'CORS' AND g.line_number = 7)")
def jon16(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(spark, sf_dir)
    seen = found.where("severity = 'CRITICAL' AND confidence = 'HIGH' AND tool_source = 'bandit' AND category = 'CORS' AND line_number = 7").select("file_path").distinct()
    return found.where("severity = 'INFO'").select("file_path").distinct().join(seen, "file_path", "left_anti")


@query("jon17_members", "SELECT n_name AS team, count(*) AS members FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def jon17(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("team"))
    return table(spark, sf_dir, "customer").select("c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("team").agg(F.count("*").alias("members"))


@query("jon18_inherited", "SELECT DISTINCT c_custkey AS user_id, r_name AS organization FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'MACHINERY' OR c_acctbal > 9000")
def jon18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access by a grant of one's own or by the chain of groups above."""
    up = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("organization"))
    return table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY' OR c_acctbal > 9000").select("c_custkey", "c_nationkey").join(up, "c_nationkey").select(F.col("c_custkey").alias("user_id"), "organization").distinct()


@query("jon20_names", f"SELECT category, {_CWE} AS cwe_id, count(*) AS n FROM findings GROUP BY 1, 2")
def jon20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy("category", pick(CWES, F.col("category")).alias("cwe_id")).agg(F.count("*").alias("n"))


@query("sec10_tickets", "SELECT f.id, p.provider FROM findings f CROSS JOIN (VALUES ('jira'), ('github')) p(provider) WHERE severity IN ('CRITICAL', 'HIGH') AND confidence = 'HIGH'")
def sec10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).where("severity IN ('CRITICAL', 'HIGH') AND confidence = 'HIGH'").select("id", F.explode(F.array(F.lit("jira"), F.lit("github"))).alias("provider"))


@query("sec08_transitive", "SELECT DISTINCT a.l_partkey AS root, b.l_partkey AS child FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_linenumber = 1")
def sec08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hop of dependencies: the next line of the same order, by a window instead of a self-join."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    edges = line.where("l_linenumber IN (1, 2)")
    return edges.where("l_linenumber = 1").alias("a").join(edges.where("l_linenumber = 2").alias("b"), "l_orderkey").select(F.col("a.l_partkey").alias("root"), F.col("b.l_partkey").alias("child")).distinct()


@query("sec12_pairing", "SELECT s.vulnerability_id, s.status, r.scan_id IS NOT NULL AS paired FROM (SELECT * FROM sla_records WHERE severity='CRITICAL') s LEFT JOIN (SELECT DISTINCT scan_id FROM agent_runs WHERE findings_count > 30) r ON r.scan_id = s.scan_id")
def sec12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts and ends paired on their key; a start without an end stays."""
    found = findings(spark, sf_dir)
    ends = found.groupBy("scan_id", "tool_source").count().where("count > 30").select("scan_id").distinct().withColumn("hit", F.lit(True))
    return sla_records(found).where("severity = 'CRITICAL'").join(ends, "scan_id", "left").select("vulnerability_id", "status", F.coalesce("hit", F.lit(False)).alias("paired"))
