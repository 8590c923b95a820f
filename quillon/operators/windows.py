"""Numbering, halves and thirds, first and last values, pages, and the scores and bands that other operators use inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.functions.scalars import period_days
from quillon.operators.context import MONEY_WORDS, PII_WORDS, REGULATIONS, production, regulations, sensitivity
from quillon.operators.risk import ASSET, EPSS_ESTIMATE, KEV, PRIORITIES, band, context_score, prioritised, sql_band, threat_score, with_threat
from quillon.operators.risk import _PRIORITY as PRIORITY_SQL
from quillon.operators.triage import ORDER, _TRIAGED as TRIAGED_SQL, escalated, triaged
from quillon.operators.ranges import ends_of, running
from quillon.plans.fixtures import CWES, RANK, findings, pick, scans, sql_pick
from quillon.sources.tables import table

#: Ids that have a public exploit without being known as exploited; order of gaps.
EXPLOITS = ("CVE-2023-38408", "CVE-2023-32629")
GAPS = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def numbered(df: DataFrame, keys: list[str], *order: Column, to: str = "place") -> DataFrame:
    """Rows numbered from 1 within each key."""
    return df.withColumn(to, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def period(text: Column) -> Column:
    """Days of a period such as 30d, 4w or 3m; null for others."""
    n = F.regexp_extract(text, r"^\s*(\d+)[dwmDWM]\s*$", 1)
    unit = F.lower(F.regexp_extract(text, r"^\s*\d+([dwmDWM])\s*$", 1))
    return F.when(n != "", n.cast("int") * pick({k: period_days(f"1{k}") for k in "dwm"}, unit))


def exploit_available(cve: Column, kev: Column) -> Column:
    return kev | F.upper(cve).isin(*EXPLOITS)


def occurrences(df: DataFrame, key: str, text: str, patterns: tuple[tuple[str, str], ...]) -> DataFrame:
    """key, kind, place and placeholder of every match, counted from 1 for each kind of a text."""
    each = F.flatten(F.array(*(F.transform(F.regexp_extract_all(F.col(text), F.lit(p), 0), lambda m, i: F.struct(F.lit(k).alias("kind"), (i + 1).cast("long").alias("place"))) for k, p in patterns)))  # noqa: B023 - called at once
    hits = df.select(key, F.explode(each).alias("h")).select(key, "h.*")
    return hits.withColumn("placeholder", F.concat(F.lit("[REDACTED_"), "kind", F.lit("_"), F.col("place").cast("string"), F.lit("]")))


_SEVERITY = sql_pick(RANK, "severity")
_ORDERED = "SELECT name, scan_id, raw_score, row_number() OVER (PARTITION BY name ORDER BY end_time, scan_id) AS k, count(*) OVER (PARTITION BY name) AS n FROM scans"


@query("win01_numbering", f"SELECT id, row_number() OVER (PARTITION BY scan_id ORDER BY {_SEVERITY} DESC, id) AS place FROM findings")
def win01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities 1..n of a scan's findings."""
    return numbered(findings(spark, sf_dir).select("id", "scan_id", "severity"), ["scan_id"], pick(RANK, F.col("severity")).desc(), F.col("id")).select("id", "place")


@query("win02_thirds", f"SELECT name, any_value(n) AS n, round_even(avg(raw_score) FILTER (k <= n // 3), 6) AS first_mean, round_even(avg(raw_score) FILTER (k > n - n // 3), 6) AS last_mean FROM ({_ORDERED}) GROUP BY 1")
def win02(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ends_of(scans(findings(spark, sf_dir)), "name", "raw_score", 3, ["end_time", "scan_id"])
    return out.select("name", "n", F.bround("first_mean", 6).alias("first_mean"), F.bround("last_mean", 6).alias("last_mean"))


@query("win03_halves", f"SELECT name, any_value(n) AS n, round_even(avg(raw_score) FILTER (k <= n // 2), 6) AS first_mean, round_even(avg(raw_score) FILTER (k > n - n // 2), 6) AS last_mean FROM ({_ORDERED}) GROUP BY 1")
def win03(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ends_of(scans(findings(spark, sf_dir)), "name", "raw_score", 2, ["end_time", "scan_id"])
    return out.select("name", "n", F.bround("first_mean", 6).alias("first_mean"), F.bround("last_mean", 6).alias("last_mean"))


@query("win04_first_last", "SELECT DISTINCT name, first_value(raw_score) OVER w AS first_score, last_value(raw_score) OVER w AS last_score FROM scans WINDOW w AS (PARTITION BY name ORDER BY end_time, scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def win04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last value by time: aggregates, which need no sort of a repository's scans."""
    at = F.struct("end_time", "scan_id")
    return scans(findings(spark, sf_dir)).groupBy("name").agg(F.min_by("raw_score", at).alias("first_score"), F.max_by("raw_score", at).alias("last_score"))


@query("win05_delta", "SELECT scan_id, risk - prev AS delta, CASE WHEN risk - prev > 5 THEN 'worsening' WHEN risk - prev < -5 THEN 'improving' ELSE 'stable' END AS trend FROM (SELECT scan_id, least(100, raw_score) AS risk, lag(least(100, raw_score)) OVER (PARTITION BY name ORDER BY end_time, scan_id) AS prev FROM scans) WHERE prev IS NOT NULL")
def win05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk (at most 100) against the scan before; first scans have no row."""
    risk = F.least(F.lit(100).cast("long"), "raw_score")
    rows = running(scans(findings(spark, sf_dir)).select("scan_id", "name", "end_time", risk.alias("risk")), "name", ["end_time", "scan_id"], previous=("risk",))
    d = rows.select("scan_id", (F.col("risk") - F.col("previous_risk")).alias("delta")).where("delta IS NOT NULL")
    return d.withColumn("trend", F.when(F.col("delta") > 5, "worsening").when(F.col("delta") < -5, "improving").otherwise("stable"))


_KINDS = (("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), ("IPV4", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"))


@query("win10_occurrences", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, place, '[REDACTED_{k}_' || place || ']' AS placeholder FROM (SELECT doc_id, unnest(generate_series(1, len(regexp_extract_all(text, '{p}')))) AS place FROM documents)" for k, p in _KINDS))
def win10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences(table(spark, sf_dir, "documents"), "doc_id", "text", _KINDS)


@query("srt06_page", "SELECT id, severity FROM findings ORDER BY id OFFSET 1000 LIMIT 100")
def srt06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("id", "severity").orderBy("id").offset(1000).limit(100)


@query("srt07_gaps", f"SELECT category, severity, n, row_number() OVER (ORDER BY {sql_pick(GAPS, 'lower(severity)', 9)}, category) AS place FROM (SELECT category, severity, count(*) AS n FROM findings WHERE severity <> 'INFO' GROUP BY 1, 2)")
def srt07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps (category and severity) in the order critical, high, medium, low; few enough for one task."""
    gaps = findings(spark, sf_dir).where("severity <> 'INFO'").groupBy("category", "severity").agg(F.count("*").alias("n"))
    return numbered(gaps, [], pick(GAPS, F.lower("severity"), 9), F.col("category"))


@query("scl02_bands", f"SELECT scan_id, raw_score / 25 AS score, {sql_band('raw_score / 25')} AS band FROM scans")
def scl02(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("raw_score") / 25
    return scans(findings(spark, sf_dir)).select("scan_id", score.alias("score"), band(score).alias("band"))


@query("scl04_assets", f"SELECT p_partkey, {sql_pick(ASSET, 'a', 1.0)}::double AS weight FROM (SELECT p_partkey, (['low', 'medium', 'high', 'critical', 'unknown'])[p_partkey % 5 + 1] AS a FROM part)")
def scl04(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("LOW", "Medium", "high", "critical", "unknown"))), (F.col("p_partkey") % 5).cast("int") + 1)
    return table(spark, sf_dir, "part").select("p_partkey", pick(ASSET, F.lower(name), 1.0).alias("weight"))


@query("scl06_context_score", "SELECT event_id, least(1, greatest(0, (event_type = 'click')::int * 0.4::double + (user_id % 2 = 0)::int * 0.3::double + (user_id % 3 <> 0)::int * 0.2::double - (event_type = 'error')::int * 0.3::double)) AS score FROM events")
def scl06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", context_score(F.col("event_type") == "click", F.col("user_id") % 2 == 0, F.col("user_id") % 3 == 0, F.col("event_type") == "error").alias("score"))


@query("scl07_threat_score", f"SELECT id, round_even(least(1, (cwe_id IN {KEV})::int * 0.5::double + (cwe_id IN {KEV} OR category = 'CORS')::int * 0.3::double + e * 0.2::double), 6) AS score FROM (SELECT id, category, {sql_pick(CWES, 'category')} AS cwe_id, ({sql_pick(EPSS_ESTIMATE, 'severity', 0.1)})::double AS e FROM findings)")
def scl07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known exploitation, an exploit, and the severity's estimate where there is no id to look up."""
    f = with_threat(findings(spark, sf_dir))
    score = threat_score(F.col("kev"), F.col("kev") | (F.col("category") == "CORS"), pick(EPSS_ESTIMATE, F.col("severity"), 0.1))
    return f.select("id", F.bround(score, 6).alias("score"))


_BUSINESS = f"SELECT conv_id, turn, CASE WHEN contains(t, 'debug = true') OR contains(t, 'debug=true') THEN 0.4::double WHEN contains(t, 'prod') THEN 0.9::double ELSE 0.6::double END AS production, CASE WHEN regexp_matches(t, '{'|'.join(PII_WORDS)}') THEN 0.4::double ELSE 0 END + CASE WHEN regexp_matches(t, '{'|'.join(MONEY_WORDS)}') THEN 0.5::double ELSE 0 END AS sensitivity, least(1, 0.25::double * (" + " + ".join(f"regexp_matches(t, '{w}')::int" for _, w in REGULATIONS) + ")) AS regulatory FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations)"


@query("scl08_business", f"SELECT *, round_even(production * 0.4::double + sensitivity * 0.4::double + regulatory * 0.2::double, 6) AS score FROM ({_BUSINESS})")
def scl08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.4 production, 0.4 sensitivity, 0.2 regulation, and the three, of every text under the path that its source makes."""
    path, t = F.concat(F.lit("src/"), "role", F.lit(".py")), F.coalesce("text", F.lit(""))
    parts = table(spark, sf_dir, "conversations").select("conv_id", "turn", production(path, t).alias("production"), F.least(sensitivity(t), F.lit(1.0)).alias("sensitivity"), F.least(F.size(regulations(t, path)) * 0.25, F.lit(1.0)).alias("regulatory"))
    return parts.withColumn("score", F.bround(F.col("production") * 0.4 + F.col("sensitivity") * 0.4 + F.col("regulatory") * 0.2, 6))


@query("scl13_priority_bands", f"SELECT {sql_band('p', PRIORITIES, 'P4')} AS band, count(*) AS n, round_even(min(p), 4) AS least FROM ({PRIORITY_SQL}) GROUP BY 1")
def scl13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prioritised(findings(spark, sf_dir)).groupBy(band(F.col("p"), PRIORITIES, "P4").alias("band")).agg(F.count("*").alias("n"), F.bround(F.min("p"), 4).alias("least"))


@query("scl16_statuses", f"SELECT CASE WHEN l_linestatus = 'O' AND confidence = 'LOW' THEN 'false_positive' ELSE status END AS status, count(*) AS n FROM ({TRIAGED_SQL}) GROUP BY 1")
def scl16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses, where a mark as a false positive (here, open ones of low confidence) goes first."""
    marked = (F.col("l_linestatus") == "O") & (F.col("confidence") == "LOW")
    return triaged(findings(spark, sf_dir)).groupBy(F.when(marked, "false_positive").otherwise(F.col("status")).alias("status")).agg(F.count("*").alias("n"))


@query("scl24_periods", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size * 7 WHEN 2 THEN p_size * 30 END AS days FROM part")
def scl24(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("d", "W", "m ", "y"))), (F.col("p_partkey") % 4).cast("int") + 1)
    return table(spark, sf_dir, "part").select("p_partkey", period(F.concat(F.col("p_size").cast("string"), unit)).alias("days"))


@query("scl36_escalated", "SELECT severity, ([" + ", ".join(f"'{s}'" for s in ORDER) + f"])[least({sql_pick({s: i for i, s in enumerate(ORDER)}, 'severity')} + 1, 4) + 1] AS escalated, {_SEVERITY} AS rank, count(*) AS n FROM findings GROUP BY ALL")
def scl36(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("severity")
    return findings(spark, sf_dir).groupBy("severity", escalated(s).alias("escalated"), pick(RANK, s).alias("rank")).agg(F.count("*").alias("n"))


@query("scl39_gate", "SELECT doc_id, coalesce(lang, '') IN ('en', 'de', 'fr') AS model_allowed, coalesce(source NOT IN ('src3', 'src5'), true) AS external_allowed FROM documents")
def scl39(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's two predicates: models on the allow-list (here, languages), and texts that may leave (here, by source)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).isin("en", "de", "fr").alias("model_allowed"), F.coalesce(~F.col("source").isin("src3", "src5"), F.lit(True)).alias("external_allowed"))


@query("sec04_exploits", "SELECT p_partkey, p_partkey % 10 = 0 OR p_partkey % 5 = 1 AS exploitable FROM part")
def sec04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known as exploited, or of an id that has a public exploit, whatever its case."""
    k = F.col("p_partkey")
    cve = F.when(k % 5 == 1, F.lit(EXPLOITS[0].lower())).otherwise(F.concat(F.lit("CVE-2000-"), k.cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", exploit_available(cve, k % 10 == 0).alias("exploitable"))
