"""Context of a finding in its source (production, sensitivity, regulation, exposure), advisories, loops of improvement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.plans.fixtures import findings
from quillon.sources.readers import cvss_band
from quillon.sources.tables import table

# What a path or text says about production, sensitive data, regulation, exposure, authentication and input.
PRODUCTION = r"production|prod|staging|stage|deploy|live|real|master|main|release"
DEVELOPMENT = "test|spec|mock|dev|debug|example|demo"
PII_WORDS = (r"ssn|social.?security", r"credit.?card|cvv|ccv", r"email|phone|address", r"dob|birth.?date", r"passport|driver.?license", r"health|medical|hipaa", r"bank.?account|routing", r"tax.?id|ein")
MONEY_WORDS = (r"payment|stripe|paypal", r"balance|transaction|transfer", r"billing|invoice|charge", r"currency|wallet|fund", r"pci.?dss|pci_dss")
REGULATIONS = (
    ("GDPR", r"gdpr|eu.*data|data.*subject|consent|right.*erasure|portability|dpo|data.*protection"), ("PCI DSS", r"pci.*dss|pci_dss|payment.*card|cardholder.*data|chd"), ("HIPAA", r"hipaa|phi|protected.*health|health.*insurance|medical.*record"),
    ("SOC2", r"soc.*2|soc2|trust.*service|security.*control"), ("CCPA", r"ccpa|california.*consumer|ca.*privacy|consumer.*right"),
)
AUTHENTICATION = (r"@login_required", r"@require_auth", r"@authenticated", r"@jwt_required", r"@oauth_required", r"@permission_required", r"@roles_required", r"@require_login", r"auth_middleware", r"authenticate", r"verify_token", r"check_permission", r"@preauthorize", r"@secured", r"@auth_required", r"passport\.authenticate", r"firebase\.auth", r"@Protect", r"@UseGuards")
USER_INPUT = r"request\.(args|form|json|data|files|values)|req\.(query|params|body|headers)|\$_(GET|POST|REQUEST)|params\[|args\[|input\(|raw_input\(|sys\.argv|\buser_input\b|\buser_data\b|\buserinput\b|\buser_supplied\b|\buntrusted\b"


def production(path: Column, text: Column) -> Column:
    """0.8 by the path, 0.3 for tests, else by the text: 0.4 for debugging, 0.9 if it names production, 0.6."""
    p, t = F.lower(path), F.lower(text)
    return F.when(p.rlike(PRODUCTION), 0.8).when(p.rlike(DEVELOPMENT), 0.3).when(t.contains("debug = true") | t.contains("debug=true"), 0.4).when(t.contains("prod"), 0.9).otherwise(0.6)


def sensitivity(text: Column) -> Column:
    """0.4 for personal and 0.5 for financial data."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t.rlike("|".join(PII_WORDS)), 0.4).otherwise(0.0) + F.when(t.rlike("|".join(MONEY_WORDS)), 0.5).otherwise(0.0)


def sensitive_kinds(text: Column, words: tuple[str, ...] = PII_WORDS) -> Column:
    t = F.lower(text)
    return F.array_compact(F.array(*(F.when(t.rlike(w), w) for w in words)))


def regulations(text: Column, path: Column) -> Column:
    """Regimes that a text or its path touches, in a fixed order; an empty text has none."""
    t, p = F.lower(text), F.lower(path)
    by_path = {"PCI DSS": "payment|billing", "HIPAA": "health|medical"}
    hit = lambda name, pattern: t.rlike(pattern) | (p.rlike(by_path[name]) if name in by_path else F.lit(False))
    return F.when(F.length(text) > 0, F.array_compact(F.array(*(F.when(hit(n, w), n) for n, w in REGULATIONS)))).otherwise(F.array().cast("array<string>"))


def business_score(path: Column, text: Column) -> Column:
    return production(path, text) * 0.4 + F.least(sensitivity(text), F.lit(1.0)) * 0.4 + F.least(F.size(regulations(text, path)) * 0.25, F.lit(1.0)) * 0.2


def around(text: Column, line: Column, before: int, after: int) -> Column:
    """The lines from so many before a line (counted from 1) to so many after it."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    first = F.greatest(F.lit(0), line - before)
    return F.array_join(F.slice(lines, first + 1, F.greatest(F.lit(0), F.least(F.size(lines), line + after) - first)), "\n")


def requires_authentication(text: Column, line: Column) -> Column:
    return around(text, line, 20, 5).rlike("(?i)" + "|".join(AUTHENTICATION))


def input_reaches(text: Column, line: Column) -> Column:
    return around(text, line, 30, 5).rlike(USER_INPUT)


def advisory(raw: Column) -> Column:
    """An advisory's id, score (version 4 before 3, 5 without), CVE aliases and fixed versions, through its nested lists."""
    doc = F.from_json(raw, "struct<id:string,severity:array<struct<type:string,score:string>>,aliases:array<string>,affected:array<struct<ranges:array<struct<events:array<struct<fixed:string>>>>>>>")
    of = lambda kind: F.element_at(F.filter(doc["severity"], lambda s: s["type"] == kind), -1)["score"].try_cast("double")
    score = F.coalesce(F.when(F.exists(doc["severity"], lambda s: s["type"] == "CVSS_V4"), of("CVSS_V4")).when(F.exists(doc["severity"], lambda s: s["type"] == "CVSS_V3"), of("CVSS_V3")), F.lit(5.0))
    events = F.flatten(F.transform(F.flatten(F.transform(doc["affected"], lambda a: a["ranges"])), lambda r: r["events"]))
    fixed = F.array_compact(F.transform(events, lambda e: e["fixed"]))
    return F.struct(doc["id"].alias("id"), score.alias("score"), cvss_band(score).alias("severity"), F.filter(doc["aliases"], lambda a: a.startswith("CVE-")).alias("cve_ids"), fixed.alias("fixed_versions"))


@query("scl09_production", "SELECT page_id, CASE WHEN regexp_matches(lower(url), '" + PRODUCTION + "') THEN 0.8::double WHEN regexp_matches(lower(url), '" + DEVELOPMENT + "') THEN 0.3::double ELSE 0.6::double END AS production FROM pages")
def scl09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", production(F.col("url"), F.lit("")).alias("production"))


@query("scl10_sensitivity", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), '" + "|".join(PII_WORDS) + "') THEN 0.4::double ELSE 0 END + CASE WHEN regexp_matches(lower(text), '" + "|".join(MONEY_WORDS) + "') THEN 0.5::double ELSE 0 END AS sensitivity FROM documents")
def scl10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sensitivity(F.col("text")).alias("sensitivity"))


_REG = ", ".join(f"CASE WHEN regexp_matches(lower(text), '{w}') THEN '{n}' END" for n, w in REGULATIONS)


@query("scl11_regulations", f"SELECT conv_id, turn, array_to_string(list_filter([{_REG}], lambda x: x IS NOT NULL), ',') AS regulations FROM conversations WHERE length(text) > 0")
def scl11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(F.length("text") > 0).select("conv_id", "turn", F.array_join(regulations(F.col("text"), F.lit("")), ",").alias("regulations"))


@query("scl12_context")
def scl12(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", requires_authentication(t, F.lit(5)).alias("authenticated"), input_reaches(t, F.lit(5)).alias("reachable"), F.bround(business_score(F.lit("src/x.py"), t), 4).alias("business"))


@query("scl12_authentication", "SELECT p_partkey, p_partkey % 21 < 19 AND p_size % 40 BETWEEN 7 AND 31 AS authenticated, p_size % 2 = 0 AND p_size % 40 <= 31 AS reachable FROM part")
def scl12_authentication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources made from the parts: each authentication word, and user input, at lines 15 to 54; the finding is on line 41."""
    k, size = F.col("p_partkey"), F.col("p_size")
    words = [w.replace("\\", "") for w in AUTHENTICATION] + ["authorised", "no guard"]
    word = F.upper(F.element_at(F.array(*map(F.lit, words)), (k % len(words)).cast("int") + 1))
    source = F.when(size % 2 == 0, F.lit("  x = request.args")).otherwise(F.lit("  x = 1"))
    pad = lambda n: F.repeat(F.lit("pass\n"), n.cast("int"))
    text = F.concat(pad(14 + size % 40), F.lit("# "), word, source, F.lit("\n"), pad(F.lit(60)))
    return table(spark, sf_dir, "part").select("p_partkey", requires_authentication(text, F.lit(41)).alias("authenticated"), input_reaches(text, F.lit(41)).alias("reachable"))


@query("sec09_advisories", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size / 5 ELSE 5.0 END::double AS score, 'CVE-' || p_partkey AS cve FROM part")
def sec09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisories written as nested JSON from the parts and flattened again."""
    severity = F.when(F.col("p_size") % 2 == 0, F.array(F.struct(F.lit("CVSS_V3").alias("type"), F.lit("1.0").alias("score")), F.struct(F.lit("CVSS_V4").alias("type"), (F.col("p_size") / 5).cast("string").alias("score")))).otherwise(F.array().cast("array<struct<type:string,score:string>>"))
    raw = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("id"), severity.alias("severity"), F.array(F.lit("GHSA-1"), F.concat(F.lit("CVE-"), F.col("p_partkey").cast("string"))).alias("aliases")))
    a = table(spark, sf_dir, "part").select("p_partkey", advisory(raw).alias("a"))
    return a.select("p_partkey", F.col("a.score").alias("score"), F.get("a.cve_ids", F.lit(0)).alias("cve"))


@query("agg45_mutation_report", "SELECT file_path AS function, count(*) AS mutants, count(*) FILTER (confidence = 'LOW') AS survived FROM findings GROUP BY 1")
def agg45(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutants and survivors of each function (findings stand for mutants, LOW for survived)."""
    return findings(spark, sf_dir).groupBy(F.col("file_path").alias("function")).agg(F.count("*").alias("mutants"), F.count_if(F.col("confidence") == "LOW").alias("survived"))


@query("srt08_targets", "SELECT file_path, missed, row_number() OVER (ORDER BY missed DESC, file_path) AS place FROM (SELECT file_path, count(*) AS missed FROM findings WHERE severity = 'INFO' GROUP BY 1) ORDER BY place LIMIT 25")
def srt08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where tests are missing most: the first 25."""
    top = findings(spark, sf_dir).where("severity = 'INFO'").groupBy("file_path").agg(F.count("*").alias("missed")).orderBy(F.desc("missed"), "file_path").limit(25)
    return top.select("file_path", "missed", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("missed"), "file_path")).cast("long").alias("place"))


@query("sec03_epss_fallback", "SELECT p_partkey, coalesce(CASE WHEN p_size > 40 THEN 0.9::double END, CASE WHEN p_size > 20 THEN 0.5::double ELSE 0.2::double END) AS epss, p_size IN (1, 2) OR p_size > 45 AS exploitable FROM part")
def sec03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A known probability, else 0.5 for what maps to a weakness, else 0.2; exploits are the listed ids and those known."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.when(size > 40, 0.9), F.when(size > 20, 0.5).otherwise(0.2)).alias("epss"), (size.isin(1, 2) | (size > 45)).alias("exploitable"))


@query("sec13_feedback", "SELECT source AS agent, count(*) FILTER (toxic = 1) AS false_positives, count(*) FILTER (toxic = 0) AS true_positives FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def sec13(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return judged.groupBy(F.col("source").alias("agent")).agg(F.count_if(F.col("toxic") == 1).alias("false_positives"), F.count_if(F.col("toxic") == 0).alias("true_positives"))


@query("srt05_top_k", "SELECT repo, file_path, n FROM (SELECT repo, file_path, count(*) AS n FROM findings GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY n DESC, file_path) <= 5")
def srt05(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = findings(spark, sf_dir).groupBy("repo", "file_path").agg(F.count("*").alias("n"))
    return counts.withColumn("k", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"), "file_path"))).where("k <= 5").drop("k")
