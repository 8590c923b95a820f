"""Jobs, tickets, dependencies, container policies, annotations, report sections, suggested tests, similar findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.operators.dedup import semantic_pairs
from quillon.operators.policy import POLICIES, REACH, evaluated, reachability, scan_facts, _EVALUATED as EVALUATED_SQL, _FACTS as FACTS_SQL
from quillon.plans.fixtures import RANK, findings, pick, sql_pick
from quillon.sources.tables import table

#: Container policies: kind of file, id, severity; the checks of operators/detectors.py.
CONTAINER_POLICIES = (
    ("dockerfile", "latest-tag", "MEDIUM"), ("dockerfile", "root-user", "HIGH"), ("dockerfile", "add-instead-of-copy", "LOW"), ("dockerfile", "env-secret", "CRITICAL"), ("dockerfile", "no-healthcheck", "LOW"), ("dockerfile", "sudo", "MEDIUM"), ("dockerfile", "curl-pipe", "HIGH"),
    ("kubernetes", "privileged", "CRITICAL"), ("kubernetes", "host-network", "HIGH"), ("kubernetes", "host-pid", "HIGH"), ("kubernetes", "escalation", "HIGH"), ("kubernetes", "no-limits", "MEDIUM"), ("kubernetes", "no-non-root", "MEDIUM"), ("kubernetes", "wildcard-verbs", "HIGH"),
)
#: Risk scores from which a report's level follows; what a text says about the tests that it needs.
LEVELS = ((75, "CRITICAL"), (50, "HIGH"), (25, "MEDIUM"))
SUGGESTIONS = (("error", r"raise|try:"), ("async", r"async "), ("edge", r"for |while "), ("null_safety", r"is None|if not "), ("mutation", r"\.append\(|\.pop\(|\.sort\("))


def suggested_tests(text: Column) -> Column:
    """Kinds of tests for a function's file: basic, and what its text asks for; more than two conditions ask for branches."""
    some = [F.lit("basic"), *(F.when(text.rlike(p), F.lit(k)) for k, p in SUGGESTIONS), F.when(F.regexp_count(text, F.lit("if ")) > 2, F.lit("branch"))]
    return F.array_sort(F.array_compact(F.array(*some)))


def risk_level(score: Column) -> Column:
    out = None
    for least, level in LEVELS:
        out = F.when(score >= least, level) if out is None else out.when(score >= least, level)
    return out.otherwise("LOW")


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as dependencies of their brand's project: direct, reachability, and the number of findings in files of their name."""
    direct = F.col("p_size") > 10
    r = reachability(direct, F.col("p_size") > 25, F.col("p_retailprice") > 1000)
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("project"), "p_partkey", direct.alias("direct"), r.alias("reachability"))
    line = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 46").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("vulnerabilities"))
    return part.join(line, "p_partkey", "left").withColumn("vulnerabilities", F.coalesce("vulnerabilities", F.lit(0).cast("long")))


_REACH = "CASE WHEN p_size > 25 AND p_retailprice > 1000 THEN 'HIGH' WHEN p_size > 25 THEN 'MEDIUM' WHEN p_size > 10 THEN 'INFO' ELSE 'LOW' END"
_DEPS = f"SELECT p_brand AS project, p_partkey, p_size > 10 AS direct, {_REACH} AS reachability, coalesce(v, 0) AS vulnerabilities FROM part LEFT JOIN (SELECT l_partkey, count(*) AS v FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 46 GROUP BY 1) ON l_partkey = p_partkey"
_JOBS = "SELECT user_id AS job_id, min(ts) AS created, CASE arg_max(event_type, event_id) WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'running' END AS status FROM events GROUP BY 1"


@query("flt14_jobs", f"SELECT job_id, status FROM ({_JOBS}) WHERE status = 'running' ORDER BY created DESC, job_id LIMIT 100")
def flt14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running jobs, newest first."""
    jobs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.min("ts").alias("created"), F.max_by("event_type", "event_id").alias("e"))
    status = F.when(F.col("e") == "purchase", "done").when(F.col("e") == "error", "failed").when(F.col("e") == "signup", "pending").otherwise("running")
    return jobs.withColumn("status", status).where("status = 'running'").orderBy(F.desc("created"), "job_id").limit(100).select("job_id", "status")


@query("flt17_tickets", "SELECT provider, scan_id, status, count(*) AS n FROM (SELECT scan_id, provider, CASE WHEN l_linestatus = 'F' THEN 'closed' ELSE 'open' END AS status FROM findings CROSS JOIN (VALUES ('jira'), ('github')) p(provider) WHERE severity IN ('CRITICAL', 'HIGH')) WHERE provider = 'jira' AND status = 'open' AND scan_id LIKE '1997%' GROUP BY ALL")
def flt17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets of a provider that are open, for the scans of one year."""
    status = F.when(F.col("l_linestatus") == "F", "closed").otherwise("open")
    tickets = findings(spark, sf_dir).where("severity IN ('CRITICAL', 'HIGH')").select("scan_id", status.alias("status"), F.explode(F.array(F.lit("jira"), F.lit("github"))).alias("provider"))
    return tickets.where(F.col("scan_id").startswith("1997") & (F.col("provider") == "jira") & (F.col("status") == "open")).groupBy("provider", "scan_id", "status").agg(F.count("*").alias("n"))


@query("flt19_reachable", f"SELECT project, p_partkey, reachability, CASE reachability WHEN 'HIGH' THEN 1.5::double ELSE 1::double END AS multiplier, vulnerabilities FROM ({_DEPS}) WHERE reachability IN ('HIGH', 'MEDIUM') AND vulnerabilities > 0")
def flt19(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dependencies(spark, sf_dir).where("reachability IN ('HIGH', 'MEDIUM') AND vulnerabilities > 0")
    return d.select("project", "p_partkey", "reachability", pick(REACH, F.col("reachability")).alias("multiplier"), "vulnerabilities")


@query("sec07_project_summary", f"SELECT project, count(*) AS total, count(*) FILTER (direct) AS direct, count(*) FILTER (NOT direct) AS transitive, " + ", ".join(f"count(*) FILTER (reachability = '{r}') AS {r.lower()}" for r in REACH) + f", count(*) FILTER (reachability IN ('HIGH', 'MEDIUM') AND vulnerabilities > 0) AS reachable_vulnerable FROM ({_DEPS}) GROUP BY 1")
def sec07(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("reachability")
    return dependencies(spark, sf_dir).groupBy("project").agg(F.count("*").alias("total"), F.count_if("direct").alias("direct"), F.count_if(~F.col("direct")).alias("transitive"), *(F.count_if(r == x).alias(x.lower()) for x in REACH), F.count_if(r.isin("HIGH", "MEDIUM") & (F.col("vulnerabilities") > 0)).alias("reachable_vulnerable"))


@query("agg47_container_policies", "SELECT kind, count(*) AS n, string_agg(id || ':' || severity, ',' ORDER BY id) AS policies FROM (VALUES " + ", ".join(map(str, CONTAINER_POLICIES)) + ") t(kind, id, severity) GROUP BY 1")
def agg47(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container policies by kind of file."""
    p = spark.createDataFrame(list(CONTAINER_POLICIES), "kind string, id string, severity string")
    return p.groupBy("kind").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "id", "severity"))), ",").alias("policies"))


@query("snk15_annotations", f"WITH facts AS ({FACTS_SQL}), e AS ({EVALUATED_SQL}) SELECT e.scan_id, f.file_path AS uri, '[' || e.mode || '] (Policy: ' || e.policy || ')' AS text, CASE WHEN e.mode = 'ERROR' THEN 'error' ELSE 'warning' END AS level FROM e JOIN (SELECT DISTINCT scan_id, file_path FROM findings WHERE severity = 'CRITICAL') f USING (scan_id) WHERE e.violated")
def snk15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A violated policy's annotation for every file with a critical finding of the scan."""
    found = findings(spark, sf_dir)
    files = found.where("severity = 'CRITICAL'").select("scan_id", F.col("file_path").alias("uri")).distinct()
    text = F.concat(F.lit("["), "mode", F.lit("] (Policy: "), "policy", F.lit(")"))
    return evaluated(scan_facts(found), POLICIES).where("violated").join(files, "scan_id").select("scan_id", "uri", text.alias("text"), F.when(F.col("mode") == "ERROR", "error").otherwise("warning").alias("level"))


_HAS = {k: "(" + " OR ".join(f"contains(text, '{w}')" for w in p.replace("\\", "").split("|")) + ")" for k, p in SUGGESTIONS}


@query("sec19_suggested_tests", "SELECT doc_id, array_to_string(list_sort(list_filter(['basic', " + ", ".join(f"CASE WHEN {h} THEN '{k}' END" for k, h in _HAS.items()) + ", CASE WHEN len(regexp_extract_all(text, 'if ')) > 2 THEN 'branch' END], lambda x: x IS NOT NULL)), ',') AS tests FROM documents WHERE text IS NOT NULL")
def sec19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(suggested_tests(F.col("text")), ",").alias("tests"))


@query("sec19_progress", "SELECT name, count(*) AS iterations, arg_max(covered, (end_time, scan_id)) AS latest, arg_max(covered, (end_time, scan_id)) >= 80 AS threshold_met FROM (SELECT name, end_time, scan_id, 100 - raw_score % 50 AS covered FROM scans) GROUP BY 1")
def sec19_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An improvement loop's history (scans stand for its rounds): rounds, last coverage, whether it may stop."""
    from quillon.plans.fixtures import scans

    s = scans(findings(spark, sf_dir)).withColumn("covered", 100 - F.col("raw_score") % 50)
    latest = F.max_by("covered", F.struct("end_time", "scan_id"))
    return s.groupBy("name").agg(F.count("*").alias("iterations"), latest.alias("latest"), (latest >= 80).alias("threshold_met"))


@query("sec20_executive", f"SELECT s.scan_id, least(100, s.raw_score) AS risk, CASE WHEN least(100, s.raw_score) >= 75 THEN 'CRITICAL' WHEN least(100, s.raw_score) >= 50 THEN 'HIGH' WHEN least(100, s.raw_score) >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS level, s.total, t.top FROM scans s JOIN (SELECT scan_id, string_agg(id, ',' ORDER BY k) AS top FROM (SELECT scan_id, id, row_number() OVER (PARTITION BY scan_id ORDER BY {sql_pick(RANK, 'severity')} DESC, id) AS k FROM findings) WHERE k <= 5 GROUP BY 1) t USING (scan_id)")
def sec20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's first section: risk, level, total and the five worst findings, kept by a bounded aggregate of each scan."""
    from quillon.plans.fixtures import scans

    found = findings(spark, sf_dir)
    worst = F.struct((-pick(RANK, F.col("severity"))).alias("r"), "id")
    place = F.row_number().over(Window.partitionBy("scan_id").orderBy(worst))
    top = found.select("scan_id", "id", "severity").withColumn("k", place).where("k <= 5").groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("k", "id"))).alias("t"))
    risk = F.least(F.lit(100).cast("long"), "raw_score")
    return scans(found).join(top, "scan_id").select("scan_id", risk.alias("risk"), risk_level(risk).alias("level"), "total", F.array_join(F.transform("t", lambda x: x["id"]), ",").alias("top"))


@query("jon12_similar", """WITH t AS (SELECT DISTINCT p_type AS g, trim(regexp_replace(regexp_replace(lower('possible flaw found by a scanner in ' || p_name || ' of ' || p_brand), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS n FROM part),
p AS (SELECT a.g, a.n AS a, b.n AS b, list_distinct(string_split(a.n, ' ')) AS s, list_distinct(string_split(b.n, ' ')) AS u FROM t a JOIN t b ON a.g = b.g AND a.n < b.n),
q AS (SELECT g, a, b, 0.6::double * (len(list_intersect(s, u)) / len(list_distinct(list_concat(s, u)))) + 0.4::double * (1 - levenshtein(a, b) / greatest(length(a), length(b))) AS v FROM p)
SELECT g AS scan_id, a, b, round_even(v, 6) AS similarity FROM q WHERE v >= 0.85""")
def jon12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of descriptions (made from the parts, a type for a scan) of similarity 0.85 and more."""
    text = F.concat(F.lit("possible flaw found by a scanner in "), "p_name", F.lit(" of "), "p_brand")
    return semantic_pairs(table(spark, sf_dir, "part").select(F.col("p_type").alias("scan_id"), text.alias("description")))
