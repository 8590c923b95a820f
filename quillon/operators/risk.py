"""Risk and priority scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.plans.fixtures import CWES, findings, pick, scans, sql_pick

#: CVSS ratio of a severity, EPSS estimate of a severity, points of a severity, weights of an asset.
CVSS_RATIO = {"CRITICAL": 0.95, "HIGH": 0.75, "MEDIUM": 0.5, "LOW": 0.25, "INFO": 0.05}
EPSS_ESTIMATE = {"CRITICAL": 0.7, "HIGH": 0.4, "MEDIUM": 0.15, "LOW": 0.03, "INFO": 0.0}
BASE_POINTS = {"CRITICAL": 10.0, "HIGH": 7.5, "MEDIUM": 5.0, "LOW": 2.5, "INFO": 1.0}
ASSET = {"low": 0.5, "medium": 1.0, "high": 1.5, "critical": 2.0}
BANDS = ((90, "Severe"), (75, "Critical"), (50, "High"), (25, "Medium"), (10, "Low"))
PRIORITIES = ((80, "P0"), (60, "P1"), (40, "P2"), (20, "P3"))
#: Threat dimensions of the driver's data, keyed by CWE: probability of exploitation, known exploited.
EPSS = {"CWE-89": 0.62, "CWE-79": 0.31, "CWE-94": 0.55, "CWE-22": 0.12}
KEV = ("CWE-89", "CWE-94")


def band(score: Column, steps: tuple[tuple[int, str], ...] = BANDS, last: str = "Minimal") -> Column:
    out = None
    for least, label in steps:
        out = F.when(score >= least, label) if out is None else out.when(score >= least, label)
    return out.otherwise(last)


def sql_band(score: str, steps: tuple[tuple[int, str], ...] = BANDS, last: str = "Minimal") -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {n} THEN '{s}'" for n, s in steps) + f" ELSE '{last}' END"


def cvss_factor(score: Column, severity: Column) -> Column:
    return F.when(score > 0, F.least(score / 10, F.lit(1.0))).otherwise(pick(CVSS_RATIO, severity, 0.5))


def composite(cvss: Column, epss: Column, kev: Column, asset: float = 1.0, reach: Column | float = 1.0) -> Column:
    """0.4 CVSS, 0.3 EPSS, 0.2 known exploited, 0.1 asset, times reachability, at most 100."""
    base = cvss * 0.4 + epss * 0.3 + F.when(kev, 0.2).otherwise(0.0) + min(asset / 2, 1.0) * 0.1
    return F.least(base * 100 * reach, F.lit(100.0))


def with_threat(found: DataFrame) -> DataFrame:
    """Findings with cwe_id, epss (0 if unknown) and kev, from small dimensions of fixed size."""
    spark = found.sparkSession
    epss = spark.createDataFrame(list(EPSS.items()), "cwe_id string, epss double")
    kev = spark.createDataFrame([(c, True) for c in KEV], "cwe_id string, kev boolean")
    joined = found.withColumn("cwe_id", pick(CWES, F.col("category"))).join(F.broadcast(epss), "cwe_id", "left").join(F.broadcast(kev), "cwe_id", "left")
    return joined.withColumns({"epss": F.coalesce("epss", F.lit(0.0)), "kev": F.coalesce("kev", F.lit(False))})


def risks(found: DataFrame, asset: str = "medium") -> DataFrame:
    return with_threat(found).withColumn("risk", composite(cvss_factor(F.col("cvss_score"), F.col("severity")), F.col("epss"), F.col("kev"), ASSET.get(asset, 1.0)))


_CVSS = f"CASE WHEN cvss_score > 0 THEN least(cvss_score/10, 1::double) ELSE {sql_pick(CVSS_RATIO, 'severity', 0.5)}::double END"
_CWE = sql_pick(CWES, "category")
_RISK = f"SELECT *, least((({_CVSS}) * 0.4::double + coalesce(({sql_pick(EPSS, 'cwe_id')})::double, 0) * 0.3::double + CASE WHEN cwe_id IN {KEV} THEN 0.2::double ELSE 0::double END + 0.05::double) * 100, 100) AS risk FROM (SELECT *, {_CWE} AS cwe_id FROM findings)"


@query("scl01_composite", f"SELECT id, round_even(risk, 1) AS risk, {sql_band('risk')} AS band FROM ({_RISK})")
def scl01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risks(findings(spark, sf_dir)).select("id", F.bround("risk", 1).alias("risk"), band(F.col("risk")).alias("band"))


@query("scl03_factors", f"SELECT id, array_to_string(list_filter([CASE WHEN ({_CVSS}) >= 0.7 THEN 'High CVSS base score' END, CASE WHEN e >= 0.5 THEN 'High EPSS probability' WHEN e > 0 THEN 'EPSS probability' END, CASE WHEN cwe_id IN {KEV} THEN 'Listed in CISA KEV catalog' END], lambda x: x IS NOT NULL), '; ') AS factors FROM (SELECT *, coalesce(({sql_pick(EPSS, 'cwe_id')})::double, 0) AS e FROM (SELECT *, {_CWE} AS cwe_id FROM findings))")
def scl03(spark: SparkSession, sf_dir: str) -> DataFrame:
    cvss = cvss_factor(F.col("cvss_score"), F.col("severity"))
    parts = F.array_compact(F.array(F.when(cvss >= 0.7, "High CVSS base score"), F.when(F.col("epss") >= 0.5, "High EPSS probability").when(F.col("epss") > 0, "EPSS probability"), F.when(F.col("kev"), "Listed in CISA KEV catalog")))
    return with_threat(findings(spark, sf_dir)).select("id", F.array_join(parts, "; ").alias("factors"))


@query("agg23_risk_profile", f"""WITH r AS ({_RISK}), s AS (SELECT scan_id, sum(risk * CASE WHEN risk >= 75 THEN 2 WHEN risk >= 50 THEN 1.5::double ELSE 1 END) / greatest(count(*) * 1.3::double, 1) AS v, count(*) FILTER (risk >= 50) AS high, count(*) AS n FROM r GROUP BY 1)
SELECT scan_id, round_even(least(100, v), 1) AS score, {sql_band('least(100, v)')} AS band, high, n FROM s""")
def agg23(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("risk") >= 75, 2.0).when(F.col("risk") >= 50, 1.5).otherwise(1.0)
    s = risks(findings(spark, sf_dir)).groupBy("scan_id").agg((F.sum(F.col("risk") * weight) / F.greatest(F.count("*") * 1.3, F.lit(1.0))).alias("v"), F.count_if(F.col("risk") >= 50).alias("high"), F.count("*").alias("n"))
    v = F.least(F.lit(100.0), "v")
    return s.select("scan_id", F.bround(v, 1).alias("score"), band(v).alias("band"), "high", "n")


@query("srt04_top_risks", f"SELECT id, round_even(risk, 1) AS risk FROM ({_RISK}) ORDER BY risk DESC, id LIMIT 10")
def srt04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risks(findings(spark, sf_dir)).orderBy(F.desc("risk"), "id").limit(10).select("id", F.bround("risk", 1).alias("risk"))


def context_score(exposed: Column, reachable: Column, auth: Column, dependency: Column) -> Column:
    points = lambda c, n: F.when(c, n).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), points(exposed, 0.4) + points(reachable, 0.3) + points(~auth, 0.2) - points(dependency, 0.3)))


def threat_score(kev: Column, exploit: Column, epss: Column) -> Column:
    return F.least(F.lit(1.0), F.when(kev, 0.5).otherwise(0.0) + F.when(exploit, 0.3).otherwise(0.0) + epss * 0.2)


def priority(severity: Column, context: Column, threat: Column, business: Column) -> Column:
    score = pick(BASE_POINTS, severity, 5.0) * 10 * 0.3 + context * 100 * 0.25 + threat * 100 * 0.25 + business * 100 * 0.2
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), score))


_PRIORITY = f"""SELECT id, least(100, ({sql_pick(BASE_POINTS, 'severity', 5.0)})::double * 10 * 0.3::double
 + least(1, greatest(0, CASE WHEN category IN ('SQL Injection','XSS') THEN 0.4::double ELSE 0 END + CASE WHEN tool_source='taint_analyzer' THEN 0.3::double ELSE 0 END + CASE WHEN NOT confidence='LOW' THEN 0.2::double ELSE 0 END - CASE WHEN category='Vulnerable Dependency' THEN 0.3::double ELSE 0 END)) * 100 * 0.25::double
 + least(1, ({sql_pick(EPSS_ESTIMATE, 'severity', 0.1)})::double * 0.2::double) * 100 * 0.25::double + CASE WHEN repo='project-0' THEN 0.8::double ELSE 0.3::double END * 0.4::double * 100 * 0.2::double) AS p FROM findings"""


@query("scl05_priority", f"SELECT id, round_even(p, 2) AS priority, {sql_band('p', PRIORITIES, 'P4')} AS band FROM ({_PRIORITY})")
def scl05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prioritised(findings(spark, sf_dir)).select("id", F.bround("p", 2).alias("priority"), band(F.col("p"), PRIORITIES, "P4").alias("band"))


def prioritised(found: DataFrame) -> DataFrame:
    """Findings with p: severity, context (by category, tool, confidence), threat (by severity), business (by repository)."""
    category = F.col("category")
    context = context_score(category.isin("SQL Injection", "XSS"), F.col("tool_source") == "taint_analyzer", F.col("confidence") == "LOW", category == "Vulnerable Dependency")
    threat = threat_score(F.lit(False), F.lit(False), pick(EPSS_ESTIMATE, F.col("severity"), 0.1))
    business = F.when(F.col("repo") == "project-0", 0.8).otherwise(0.3) * 0.4
    return found.withColumn("p", priority(F.col("severity"), context, threat, business))


@query("srt03_prioritised", f"SELECT id, round_even(p, 2) AS priority FROM ({_PRIORITY}) ORDER BY p DESC, id LIMIT 100")
def srt03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prioritised(findings(spark, sf_dir)).orderBy(F.desc("p"), "id").limit(100).select("id", F.bround("p", 2).alias("priority"))


@query("jon19_prev_scan", "WITH p AS (SELECT name, scan_id, raw_score, lag(raw_score) OVER (PARTITION BY name ORDER BY end_time, scan_id) AS prev FROM scans) SELECT scan_id, raw_score - prev AS delta, CASE WHEN prev IS NULL THEN NULL WHEN raw_score - prev > 5 THEN 'worsening' WHEN raw_score - prev < -5 THEN 'improving' ELSE 'stable' END AS trend FROM p")
def jon19(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev = F.lag("raw_score").over(Window.partitionBy("name").orderBy("end_time", "scan_id"))
    delta = scans(findings(spark, sf_dir)).select("scan_id", (F.col("raw_score") - prev).alias("delta"))
    return delta.select("scan_id", "delta", F.when(F.col("delta") > 5, "worsening").when(F.col("delta") < -5, "improving").when(F.col("delta").isNotNull(), "stable").alias("trend"))


@query("scl28_cvss_of_severity", f"SELECT severity, {sql_pick({'CRITICAL': 9.0, 'HIGH': 7.5, 'MEDIUM': 5.0, 'LOW': 2.0, 'INFO': 0.0}, 'severity')}::double AS cvss, count(*) AS n FROM findings GROUP BY 1, 2")
def scl28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy("severity", pick({"CRITICAL": 9.0, "HIGH": 7.5, "MEDIUM": 5.0, "LOW": 2.0, "INFO": 0.0}, F.col("severity")).alias("cvss")).agg(F.count("*").alias("n"))


@query("scl29_override", f"SELECT id, CASE WHEN cwe_id IN {KEV} THEN 'CRITICAL' WHEN ({sql_pick(EPSS, 'cwe_id')}) > 0.3 AND severity <> 'CRITICAL' THEN 'HIGH' ELSE severity END AS severity FROM (SELECT *, {_CWE} AS cwe_id FROM findings)")
def scl29(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("severity")
    return with_threat(findings(spark, sf_dir)).select("id", F.when(F.col("kev"), "CRITICAL").when((F.col("epss") > 0.3) & (s != "CRITICAL"), "HIGH").otherwise(s).alias("severity"))
