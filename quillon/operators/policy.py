"""Policies, compliance, reachability, heuristic triage, executive texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.operators.aggregates import POSTURES, ladder, sql_ladder
from quillon.operators.filters import SECRET_WORDS
from quillon.operators.joins import _CONTROLS, agg36, controls
from quillon.plans.fixtures import findings, pick, scans, sql_pick
from quillon.sources.tables import table

#: Built-in policies: name, condition, its argument, its threshold, mode.
POLICIES = (
    ("block-critical", "severity_count", "CRITICAL", 1, "ERROR"), ("block-high-count", "severity_count", "HIGH", 10, "ERROR"), ("secret-review", "secret_detection", "", 1, "WARN"), ("require-scan", "scan_completed", "", 1, "WARN"),
    ("max-findings", "min_risk_score", "", 80, "AUDIT"), ("block-sql-injection", "category_match", "sql injection", 1, "ERROR"), ("no-dast", "tool_match", "dast_scanner", 1, "AUDIT"), ("core-path", "path_pattern", "^src/a", 1, "WARN"),
)
#: Shifts of a confidence level, what a test file is called, multipliers of reachability.
LEVELS = ("LOW", "MEDIUM", "HIGH")
REACH = {"HIGH": 1.5, "MEDIUM": 1.0, "LOW": 0.7, "INFO": 0.3}
LANGUAGES = {".py": "python", ".js": "javascript", ".java": "java", ".go": "go", ".rb": "ruby", ".html": "html"}


def scan_facts(found: DataFrame) -> DataFrame:
    """One row a scan with what any condition asks for; policies are evaluated on these, never on the findings again."""
    extra = found.groupBy("scan_id").agg(F.collect_set(F.lower("category")).alias("categories"), F.collect_set(F.lower("tool_source")).alias("tools"), F.collect_set("file_path").alias("paths"))
    return scans(found).join(extra, "scan_id").withColumn("risk_score", F.least(F.lit(100).cast("long"), "raw_score"))


def condition(kind: str, argument: str, threshold: int) -> Column:
    """Whether a condition is met by a row of scan_facts(); a count of 0 asks for 1."""
    if kind == "severity_count":
        return F.col((argument or "HIGH").lower()) >= (threshold or 1)
    if kind == "category_match":
        return F.array_contains("categories", argument.lower())
    if kind == "tool_match":
        return F.array_contains("tools", argument.lower())
    if kind == "secret_detection":
        return F.exists("categories", lambda c: c.rlike("|".join(SECRET_WORDS)))
    if kind == "max_risk_score":
        return F.col("risk_score") <= (threshold or 100)
    if kind == "min_risk_score":
        return F.col("risk_score") >= threshold
    if kind == "scan_completed":
        return F.col("status") == "completed"
    if kind == "path_pattern":
        return F.exists("paths", lambda p: p.rlike(argument))
    return F.lit(False)


def evaluated(facts: DataFrame, policies: tuple = POLICIES) -> DataFrame:
    """scan_id, policy, mode and violated for every scan and policy; the policies are a literal of the plan."""
    each = F.array(*(F.struct(F.lit(n).alias("policy"), F.lit(m).alias("mode"), condition(k, a, t).alias("violated")) for n, k, a, t, m in policies))
    return facts.select("scan_id", F.explode(each).alias("p")).select("scan_id", "p.*")


def exit_code(mode: Column, violated: Column) -> Column:
    """2 if an error failed, 1 if a warning did, else 0; audits never count. An aggregate over a scan's policies."""
    return F.when(F.count_if(violated & (mode == "ERROR")) > 0, 2).when(F.count_if(violated & (mode == "WARN")) > 0, 1).otherwise(0)


def phased(mode: Column, now: Column, transition: Column) -> Column:
    """A phased policy warns until its transition date."""
    return F.when((mode == "PHASED") & (now < transition), "WARN").when(mode == "PHASED", "ERROR").otherwise(mode)


def shifted_confidence(level: Column, steps: int) -> Column:
    at = pick({s: i for i, s in enumerate(LEVELS)}, level, 1)
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.least(F.lit(2), F.greatest(F.lit(0), at + steps)) + 1)


_FACTS = "SELECT s.*, least(100, raw_score) AS risk_score, c.categories, c.tools, c.paths FROM scans s JOIN (SELECT scan_id, list(DISTINCT lower(category)) AS categories, list(DISTINCT tool_source) AS tools, list(DISTINCT file_path) AS paths FROM findings GROUP BY 1) c USING (scan_id)"
_CONDITIONS = {"block-critical": "critical >= 1", "block-high-count": "high >= 10", "secret-review": "list_contains(categories, 'hardcoded secret')", "require-scan": "status = 'completed'", "max-findings": "risk_score >= 80", "block-sql-injection": "list_contains(categories, 'sql injection')", "no-dast": "list_contains(tools, 'dast_scanner')", "core-path": "len(list_filter(paths, lambda p: starts_with(p, 'src/a'))) > 0"}
_EVALUATED = " UNION ALL ".join(f"SELECT scan_id, '{n}' AS policy, '{m}' AS mode, {_CONDITIONS[n]} AS violated FROM facts" for n, _, _, _, m in POLICIES)


@query("scl40_policies", f"WITH facts AS ({_FACTS}) {_EVALUATED}")
def scl40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(scan_facts(findings(spark, sf_dir)))


@query("scl42_exit_codes", f"WITH facts AS ({_FACTS}), e AS ({_EVALUATED}) SELECT scan_id, CASE WHEN count(*) FILTER (violated AND mode='ERROR') > 0 THEN 2 WHEN count(*) FILTER (violated AND mode='WARN') > 0 THEN 1 ELSE 0 END AS exit_code, count(*) FILTER (violated) AS violations FROM e GROUP BY 1")
def scl42(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(scan_facts(findings(spark, sf_dir))).groupBy("scan_id").agg(exit_code(F.col("mode"), F.col("violated")).alias("exit_code"), F.count_if("violated").alias("violations"))


@query("scl41_phased", "SELECT o_orderkey, CASE WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN 'WARN' ELSE 'ERROR' END AS mode FROM orders")
def scl41(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", phased(F.lit("PHASED"), F.lit("1998-01-01").cast("timestamp_ntz"), F.col("o_orderdate")).alias("mode"))


@query("scl18_confidence_shift", "SELECT id, CASE confidence WHEN 'HIGH' THEN 'MEDIUM' ELSE 'LOW' END AS lower, CASE confidence WHEN 'LOW' THEN 'MEDIUM' ELSE 'HIGH' END AS higher FROM findings")
def scl18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("id", shifted_confidence(F.col("confidence"), -1).alias("lower"), shifted_confidence(F.col("confidence"), 1).alias("higher"))


def heuristic_verdict(fp: Column, tp: Column, test_file: Column, known: Column) -> Column:
    """Test files and known patterns are false positives; else two points either way decide, false positives first."""
    return F.when(test_file | known, "false_positive").when(fp >= 2, "false_positive").when(tp >= 2, "true_positive").otherwise("uncertain")


@query("scl17_verdicts", "SELECT id, CASE WHEN regexp_matches(file_path, 'rose|test') THEN 'false_positive' WHEN f >= 2 THEN 'false_positive' WHEN t >= 2 THEN 'true_positive' ELSE 'uncertain' END AS verdict FROM (SELECT id, file_path, (confidence='LOW')::int + (severity='INFO')::int + (category='CORS')::int AS f, (confidence='HIGH')::int + (severity IN ('CRITICAL','HIGH'))::int + (tool_source='taint_analyzer')::int AS t FROM findings)")
def scl17(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c: c.cast("int")
    f = one(F.col("confidence") == "LOW") + one(F.col("severity") == "INFO") + one(F.col("category") == "CORS")
    t = one(F.col("confidence") == "HIGH") + one(F.col("severity").isin("CRITICAL", "HIGH")) + one(F.col("tool_source") == "taint_analyzer")
    return findings(spark, sf_dir).select("id", heuristic_verdict(f, t, F.col("file_path").rlike("rose|test"), F.lit(False)).alias("verdict"))


def reachability(direct: Column, imported: Column, used: Column) -> Column:
    """HIGH if imported and used, MEDIUM if imported, INFO if only declared, LOW if only pulled in by another."""
    return F.when(imported & used, "HIGH").when(imported, "MEDIUM").when(direct, "INFO").otherwise("LOW")


@query("scl30_reachability", "SELECT p_partkey, r AS reachability, CASE r WHEN 'HIGH' THEN 1.5::double WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 0.7::double ELSE 0.3::double END AS multiplier FROM (SELECT p_partkey, CASE WHEN p_size > 25 AND p_retailprice > 1000 THEN 'HIGH' WHEN p_size > 25 THEN 'MEDIUM' WHEN p_size > 10 THEN 'INFO' ELSE 'LOW' END AS r FROM part)")
def scl30(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reachability(F.col("p_size") > 10, F.col("p_size") > 25, F.col("p_retailprice") > 1000)
    return table(spark, sf_dir, "part").select("p_partkey", r.alias("reachability"), pick(REACH, r).alias("multiplier"))


@query("jon14_import_names", "SELECT p.p_partkey, count(DISTINCT f.file_path) AS files FROM part p JOIN findings f ON f.file_path = 'src/' || replace(p.p_name, ' ', '_') || '.py' GROUP BY 1")
def jon14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies and the files that import them, by normalised name."""
    names = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"))
    files = findings(spark, sf_dir).select("file_path").distinct().withColumn("name", F.lower(F.regexp_extract("file_path", r"([^/]+)\.py$", 1)))
    return names.join(files, "name").groupBy("p_partkey").agg(F.count_distinct("file_path").alias("files"))


@query("agg41_languages", f"SELECT {sql_pick(LANGUAGES, 'e', 'other')} AS language, count(*) AS files FROM (SELECT lower(regexp_extract(url, '(\\.[a-z]+)$', 1)) AS e FROM pages) GROUP BY 1")
def agg41(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(pick(LANGUAGES, F.lower(F.regexp_extract("url", r"(\.[a-z]+)$", 1)), "other").alias("language")).agg(F.count("*").alias("files"))


@query("agg37_gaps", f"WITH j AS (SELECT c.control, count(f.id) AS findings, count(f.id) FILTER (f.severity IN ('CRITICAL','HIGH')) AS severe FROM (VALUES {_CONTROLS}) c(control, category) LEFT JOIN findings f ON f.category = c.category GROUP BY 1) SELECT control, CASE WHEN severe > 0 THEN 'critical' ELSE 'medium' END AS gap, row_number() OVER (ORDER BY severe > 0 DESC, control) AS place FROM j WHERE findings > 0")
def agg37(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls with findings, the worst first; there are as many rows as controls."""
    gaps = agg36(spark, sf_dir).where("findings > 0").withColumn("worst", F.col("severe") > 0)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("worst"), "control")).cast("long")
    return gaps.select("control", F.when(F.col("worst"), "critical").otherwise("medium").alias("gap"), place.alias("place"))


@query("agg39_compliance_summary", "SELECT name, cast(sum(critical + high + medium + low + info) as bigint) AS total, count(*) AS scans FROM scans GROUP BY 1")
def agg39(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans(findings(spark, sf_dir)).groupBy("name").agg(F.sum(F.expr("critical + high + medium + low + info")).alias("total"), F.count("*").alias("scans"))


def maturity(pct: Column, severe_gaps: Column, scans_seen: Column, strict: bool = False) -> Column:
    """The compliance rate cut to a whole number; strict adds the boost of many scans and the penalty of severe gaps."""
    base = F.floor(pct).cast("long")
    return base if not strict else F.least(F.lit(100).cast("long"), F.greatest(F.lit(0).cast("long"), base + F.when(scans_seen >= 10, 5).otherwise(0) - 5 * severe_gaps))


@query("sec15_maturity", "SELECT name, cast(floor(100.0 * count(*) FILTER (critical = 0) / count(*)) as bigint) AS maturity, CASE WHEN 100.0 * count(*) FILTER (critical = 0) / count(*) >= 85 THEN 'low' WHEN 100.0 * count(*) FILTER (critical = 0) / count(*) >= 55 THEN 'medium' ELSE 'high' END AS risk FROM scans GROUP BY 1")
def sec15(spark: SparkSession, sf_dir: str) -> DataFrame:
    pct = 100.0 * F.count_if(F.col("critical") == 0) / F.count("*")
    s = scans(findings(spark, sf_dir)).groupBy("name").agg(pct.alias("pct"))
    return s.select("name", maturity(F.col("pct"), F.lit(0), F.lit(0)).alias("maturity"), F.when(F.col("pct") >= 85, "low").when(F.col("pct") >= 55, "medium").otherwise("high").alias("risk"))


@query("sec14_recommendations", f"SELECT scan_id, {sql_ladder('100 - least(100, raw_score)', POSTURES, 'Critical')} AS posture, array_to_string(list_filter([CASE WHEN raw_score > 50 THEN 'posture' END, CASE WHEN critical > 0 THEN critical || ' critical' END, CASE WHEN high > 10 THEN high || ' high' END], lambda x: x IS NOT NULL), '; ') AS recommendations FROM scans")
def sec14(spark: SparkSession, sf_dir: str) -> DataFrame:
    posture = 100 - F.least(F.lit(100).cast("long"), "raw_score")
    texts = F.array_compact(F.array(F.when(F.col("raw_score") > 50, "posture"), F.when(F.col("critical") > 0, F.format_string("%d critical", "critical")), F.when(F.col("high") > 10, F.format_string("%d high", "high"))))
    return scans(findings(spark, sf_dir)).select("scan_id", ladder(posture, POSTURES, "Critical").alias("posture"), F.array_join(texts, "; ").alias("recommendations"))


@query("sec16_suggested_fix", "SELECT scan_id, array_to_string(list_filter(list(CASE WHEN confidence = 'HIGH' THEN category END ORDER BY id)[1:3], lambda x: x IS NOT NULL), '; ') AS fixes FROM findings GROUP BY 1")
def sec16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixes of a scan's first three findings: cut to three first, then those without a fix go."""
    items = F.array_sort(F.collect_list(F.struct("id", F.when(F.col("confidence") == "HIGH", F.col("category")).alias("fix"))))
    g = findings(spark, sf_dir).groupBy("scan_id").agg(items.alias("f"))
    return g.select("scan_id", F.array_join(F.array_compact(F.transform(F.slice("f", 1, 3), lambda x: x["fix"])), "; ").alias("fixes"))


@query("sec17_built_in", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{k}', '{m}')" for n, k, _, _, m in POLICIES) + ") p(policy, kind, mode)")
def sec17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, k, m) for n, k, _, _, m in POLICIES], "policy string, kind string, mode string")


@query("flt16_frameworks", f"SELECT DISTINCT control FROM (VALUES {_CONTROLS}) c(control, category) WHERE category IN ('XSS', 'CORS')")
def flt16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controls(spark).groupBy("control").agg(F.collect_set("category").alias("c")).where(F.arrays_overlap("c", F.array(F.lit("XSS"), F.lit("CORS")))).select("control")


@query("flt18_strong_chains", "SELECT repo, file_path, count(*) AS nodes FROM findings WHERE confidence = 'HIGH' GROUP BY 1, 2 HAVING count(DISTINCT tool_source) > 1 ORDER BY nodes DESC, repo, file_path LIMIT 10")
def flt18(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = findings(spark, sf_dir).where("confidence = 'HIGH'").groupBy("repo", "file_path").agg(F.count("*").alias("nodes"), F.count_distinct("tool_source").alias("t"))
    return g.where("t > 1").drop("t").orderBy(F.desc("nodes"), "repo", "file_path").limit(10)


@query("flt20_expired", "SELECT o_orderkey AS grant_id FROM orders WHERE o_orderdate + INTERVAL 365 DAY < TIMESTAMP '1997-01-01'")
def flt20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderdate + INTERVAL 365 DAYS < TIMESTAMP_NTZ '1997-01-01'").select(F.col("o_orderkey").alias("grant_id"))


@query("agg50_chain_edges", "SELECT repo, id AS source, lead(id) OVER (PARTITION BY repo, file_path ORDER BY line_number, id) AS target FROM findings WHERE severity = 'CRITICAL' QUALIFY target IS NOT NULL")
def agg50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between neighbouring nodes of a chain."""
    w = Window.partitionBy("repo", "file_path").orderBy("line_number", "id")
    return findings(spark, sf_dir).where("severity = 'CRITICAL'").select("repo", F.col("id").alias("source"), F.lead("id").over(w).alias("target")).where("target IS NOT NULL")


@query("jon07_projects", "WITH p(project, part) AS (VALUES ('one', 'project-1'), ('any', 'project-'), ('none', 'zzz')) SELECT p.project, count(s.scan_id) AS scans FROM p LEFT JOIN scans s ON contains(s.name, p.part) GROUP BY 1")
def jon07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects and scans by substring of the name: the few distinct names are matched, not the scans."""
    projects = spark.createDataFrame([("one", "project-1"), ("any", "project-"), ("none", "zzz")], "project string, part string")
    names = scans(findings(spark, sf_dir)).groupBy("name").agg(F.count("*").alias("n"))
    return names.join(F.broadcast(projects), F.col("name").contains(F.col("part")), "right").groupBy("project").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scans"))


