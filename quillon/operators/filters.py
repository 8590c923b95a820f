"""Filters, pages, sorts and set operations over findings, scans and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.operators.dedup import dedup
from quillon.plans.fixtures import RANK, as_of, audit_log, bus_messages, findings, pick, scans, sla_records, sql_pick

#: Words that mark a category as a secret.
SECRET_WORDS = ("secret", "password", "token", "api key", "credential")


def severity_filter(found: DataFrame, allowed: tuple[str, ...] = (), include_info: bool = True) -> DataFrame:
    """An allow-list wins; without one INFO goes if it is not wanted."""
    if allowed:
        return found.where(F.col("severity").isin([s.upper() for s in allowed]))
    return found if include_info else found.where("severity <> 'INFO'")


def results(found: DataFrame, severity: str | None = None, category: str | None = None, tool: str | None = None) -> DataFrame:
    """Severity and tool by equality, category by substring, all ignoring case."""
    if severity:
        found = found.where(F.col("severity") == severity.upper())
    if category:
        found = found.where(F.lower("category").contains(category.lower()))
    return found.where(F.col("tool_source") == tool) if tool else found


def page(df: DataFrame, *order: object, limit: int = 100, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def audit_query(log: DataFrame, limit: int = 1000, offset: int = 0, since: str | None = None, until: str | None = None, **equal: object) -> DataFrame:
    """Equality filters and a time range, newest first."""
    for name, value in equal.items():
        if value is not None:
            log = log.where(F.col(name) == value)
    for op, bound in ((">=", since), ("<=", until)):
        if bound:
            log = log.where(f"timestamp {op} TIMESTAMP_NTZ '{bound}'")
    return page(log, F.desc("sequence_number"), limit=limit, offset=offset)


@query("flt01_severity", "SELECT id, severity FROM findings WHERE severity IN ('CRITICAL', 'HIGH')")
def flt01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity_filter(findings(spark, sf_dir), ("critical", "high")).select("id", "severity")


@query("flt01_no_info", "SELECT severity, count(*) AS n FROM findings WHERE severity <> 'INFO' GROUP BY 1")
def flt01_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity_filter(findings(spark, sf_dir), include_info=False).groupBy("severity").agg(F.count("*").alias("n"))


@query("flt02_results_page", "SELECT id, file_path, severity, category FROM findings WHERE severity='HIGH' AND lower(category) LIKE '%injection%' AND tool_source='semgrep' ORDER BY id LIMIT 100 OFFSET 20")
def flt02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(results(findings(spark, sf_dir), "high", "Injection", "semgrep").select("id", "file_path", "severity", "category"), "id", offset=20)


@query("flt02_results_total", "SELECT count(*) AS total FROM findings WHERE severity='HIGH' AND lower(category) LIKE '%injection%'")
def flt02_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(findings(spark, sf_dir), "high", "injection").agg(F.count("*").alias("total"))


@query("flt03_secrets", "SELECT id, category FROM findings WHERE regexp_matches(lower(category), 'secret|password|token|api key|credential')")
def flt03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).where(F.lower("category").rlike("|".join(SECRET_WORDS))).select("id", "category")


@query("flt04_dependencies", "SELECT scan_id, count(*) AS n FROM findings WHERE tool_source='osv_scanner' OR lower(category) LIKE '%dependency%' OR lower(category) LIKE '%vulnerable%' GROUP BY 1")
def flt04(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.lower("category")
    return findings(spark, sf_dir).where((F.col("tool_source") == "osv_scanner") | c.contains("dependency") | c.contains("vulnerable")).groupBy("scan_id").agg(F.count("*").alias("n"))


@query("flt05_history", "SELECT scan_id, name, status, total AS vulnerability_count FROM scans ORDER BY end_time DESC, scan_id LIMIT 100")
def flt05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(scans(findings(spark, sf_dir)), F.desc("end_time"), "scan_id").select("scan_id", "name", "status", F.col("total").alias("vulnerability_count"))


@query("flt06_sla_records", "SELECT vulnerability_id, scan_id FROM sla_records WHERE severity='CRITICAL' AND status='open'")
def flt06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sla_records(findings(spark, sf_dir)).where("severity = 'CRITICAL' AND status = 'open'").select("vulnerability_id", "scan_id")


@query("flt08_breaches", "SELECT vulnerability_id, severity, status FROM sla_records WHERE status NOT IN ('remediated','dismissed') AND TIMESTAMP '2001-09-01' > sla_deadline")
def flt08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sla_records(findings(spark, sf_dir)).where(~F.col("status").isin("remediated", "dismissed") & (as_of() > F.col("sla_deadline"))).select("vulnerability_id", "severity", "status")


@query("flt08_approaching", "SELECT vulnerability_id, sla_deadline FROM sla_records WHERE status NOT IN ('remediated','dismissed') AND sla_deadline > TIMESTAMP '2001-09-01' AND sla_deadline <= TIMESTAMP '2001-09-01' + INTERVAL 30 DAY")
def flt08_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("sla_deadline")
    return sla_records(findings(spark, sf_dir)).where(~F.col("status").isin("remediated", "dismissed") & (d > as_of()) & (d <= as_of() + F.expr("INTERVAL 30 DAYS"))).select("vulnerability_id", "sla_deadline")


@query("flt09_audit_query", "SELECT sequence_number, actor_id, action FROM audit_log WHERE action='purchase' AND \"timestamp\" >= TIMESTAMP '2024-01-10' ORDER BY sequence_number DESC LIMIT 200 OFFSET 10")
def flt09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_query(audit_log(spark, sf_dir), 200, 10, since="2024-01-10 00:00:00", action="purchase").select("sequence_number", "actor_id", "action")


@query("flt10_tenant", "SELECT scan_id, count(*) AS n FROM findings WHERE repo = 'project-3' GROUP BY 1")
def flt10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tenant_rows(findings(spark, sf_dir), "project-3", False, "repo").groupBy("scan_id").agg(F.count("*").alias("n"))


def tenant_rows(df: DataFrame, organization: str, super_admin: bool = False, field: str = "organization_id") -> DataFrame:
    """Rows of the user's organization; all of them for a super admin."""
    return df if super_admin else df.where(F.col(field) == organization)


@query("flt11_members", "SELECT c_custkey AS user_id, c_mktsegment AS team FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def flt11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_mktsegment = 'BUILDING' AND c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("team"))


@query("flt12_message_history", "SELECT * FROM (SELECT event_id, agent_id, message_type FROM bus_messages WHERE message_type='error' ORDER BY event_id DESC LIMIT 100) ORDER BY event_id")
def flt12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last messages of a type, oldest first."""
    return bus_messages(spark, sf_dir).where("message_type = 'error'").select("event_id", "agent_id", "message_type").orderBy(F.desc("event_id")).limit(100).orderBy("event_id")


@query("flt13_delivery_log", "SELECT event_id, ts, agent_id FROM bus_messages WHERE agent_id = 3 ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 5")
def flt13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(bus_messages(spark, sf_dir).where("agent_id = 3").select("event_id", "ts", "agent_id"), F.desc("ts"), F.desc("event_id"), limit=50, offset=5)


@query("flt15_scope_glob", "SELECT repo, file_path, count(*) AS n FROM findings WHERE repo = 'project-1' AND (file_path LIKE 'src/b%' OR file_path LIKE '%bol_.py') GROUP BY 1, 2")
def flt15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope match: repository by equality, path by any of several globs."""
    globs = F.array(F.lit("src/b*"), F.lit("*bol?.py"))
    hit = F.exists(globs, lambda g: F.regexp("file_path", glob_regex(g)))
    return findings(spark, sf_dir).where((F.col("repo") == "project-1") & hit).groupBy("repo", "file_path").agg(F.count("*").alias("n"))


def glob_regex(glob: F.Column) -> F.Column:
    """A glob as an anchored expression: * any text, ? one character, everything else as it stands."""
    quoted = F.regexp_replace(glob, r"([.+^$(){}|\\\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


@query("srt01_sorted", f"SELECT id, row_number() OVER (PARTITION BY scan_id ORDER BY {sql_pick(RANK, 'severity')} DESC, file_path, line_number, id) AS place FROM findings")
def srt01(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("scan_id").orderBy(pick(RANK, F.col("severity")).desc(), "file_path", "line_number", "id")
    return findings(spark, sf_dir).select("id", F.row_number().over(w).cast("long").alias("place"))


@query("srt09_priority_queue", "SELECT event_id, priority FROM bus_messages ORDER BY priority, event_id LIMIT 500")
def srt09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bus_messages(spark, sf_dir).select("event_id", "priority").orderBy("priority", "event_id").limit(500)


_A, _B = "repo = 'project-1'", "repo = 'project-2'"


@query("set01_diff", f"""WITH a AS (SELECT DISTINCT file_path, line_number, category FROM findings WHERE {_A}), b AS (SELECT DISTINCT file_path, line_number, category FROM findings WHERE {_B})
SELECT coalesce(a.file_path, b.file_path) AS file_path, coalesce(a.line_number, b.line_number) AS line_number, coalesce(a.category, b.category) AS category, CASE WHEN a.file_path IS NULL THEN 'new' WHEN b.file_path IS NULL THEN 'fixed' ELSE 'unchanged' END AS state
FROM a FULL JOIN b ON a.file_path=b.file_path AND a.line_number=b.line_number AND a.category=b.category""")
def set01(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(spark, sf_dir)
    return scan_diff(found.where(_A), found.where(_B))


def scan_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys with their state: new in b, fixed since a, or unchanged; one aggregation, no join."""
    keys = ["file_path", "line_number", "category"]
    both = a.select(*keys, F.lit(1).alias("side")).unionByName(b.select(*keys, F.lit(2).alias("side")))
    return both.groupBy(*keys).agg(F.bit_or("side").alias("s")).select(*keys, F.when(F.col("s") == 2, "new").when(F.col("s") == 1, "fixed").otherwise("unchanged").alias("state"))


@query("set01_summary", f"""WITH a AS (SELECT DISTINCT file_path, line_number, category FROM findings WHERE {_A}), b AS (SELECT DISTINCT file_path, line_number, category FROM findings WHERE {_B})
SELECT (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS new, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS fixed, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS unchanged""")
def set01_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(spark, sf_dir)
    return scan_diff(found.where(_A), found.where(_B)).agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("new", "fixed", "unchanged")))


@query("set02_union", "SELECT tool_source, count(*) AS n FROM (SELECT * FROM findings WHERE tool_source='semgrep' UNION ALL SELECT * FROM findings WHERE tool_source='bandit') GROUP BY 1")
def set02(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(spark, sf_dir)
    return found.where("tool_source = 'semgrep'").unionByName(found.where("tool_source = 'bandit'")).groupBy("tool_source").agg(F.count("*").alias("n"))


@query("set03_merge", "SELECT file_path, line_number, coalesce(max(id) FILTER (tool_source='bandit'), max(id) FILTER (tool_source='semgrep')) AS id FROM findings WHERE tool_source IN ('bandit','semgrep') GROUP BY 1, 2")
def set03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keyed results merged; where both have a key the right one wins."""
    of = lambda tool: F.max(F.when(F.col("tool_source") == tool, F.col("id")))
    return findings(spark, sf_dir).where("tool_source IN ('bandit', 'semgrep')").groupBy("file_path", "line_number").agg(F.coalesce(of("bandit"), of("semgrep")).alias("id"))


@query("set04_union_of_sets", "SELECT repo, array_to_string(list_sort(list(DISTINCT tool_source)), ',') AS tools, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories FROM findings GROUP BY 1")
def set04(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return findings(spark, sf_dir).groupBy("repo").agg(joined("tool_source").alias("tools"), joined("category").alias("categories"))


@query("set05_overlap", "SELECT scan_id, list_has_any(list(DISTINCT category), ['XSS','CORS']) AS web FROM deduped GROUP BY 1")
def set05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(findings(spark, sf_dir)).groupBy("scan_id").agg(F.arrays_overlap(F.collect_set("category"), F.array(F.lit("XSS"), F.lit("CORS"))).alias("web"))
