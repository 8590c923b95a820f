"""Stores of the engine read back: JSON documents, SQLite files, source trees, archives, daily logs, audit exports, policy files."""

from __future__ import annotations

import io
import json
import sqlite3
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.operators.policy import condition, scan_facts
from quillon.plans.fixtures import audit_log, bus_messages, findings, scans
from quillon.sources.readers import category_of, json_store, source_files
from quillon.sources.shared import replace_files, shared_path
from quillon.sources.tables import dealt, table
from quillon.sources.tools import append_daily, daily_log, policy_file, unzipped

SCAN = "scan_id string, status string, total long, raw_score long"


def sqlite_table(spark: SparkSession, path: str, sql: str, schema: str) -> DataFrame:
    """The rows of a statement over each SQLite file of a folder; a file is opened from its bytes, wherever Spark can read it."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                con = sqlite3.connect(":memory:")
                con.deserialize(bytes(content))
                cursor = con.execute(sql)
                while rows := cursor.fetchmany(10_000):
                    yield pd.DataFrame(rows, columns=names)
                con.close()

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.db").load(path).select("content").mapInPandas(run, schema)


def sqlite_files(df: DataFrame, key: str, name: str, columns: tuple[str, ...]) -> DataFrame:
    """name and content of one SQLite file with a table for each key."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        con = sqlite3.connect(":memory:")
        group[list(columns)].to_sql(name, con, index=False)
        content = con.serialize()
        con.close()
        return pd.DataFrame({"name": [f"{group[key].iloc[0]}.db"], "content": [content]})

    return df.groupBy(key).applyInPandas(run, "name string, content binary")


def zip_files(df: DataFrame, key: str, name: str, content: str) -> DataFrame:
    """name and content of one zip file for each key."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, c in sorted(zip(group[name], group[content])):
                z.writestr(n, c)
        return pd.DataFrame({"name": [f"{group[key].iloc[0]}.zip"], "content": [out.getvalue()]})

    return df.select(key, name, content).groupBy(key).applyInPandas(run, "name string, content binary")


def exported(log: DataFrame, to: str, kind: str) -> None:
    """An audit log in ascending sequence, as CSV with a header or as JSON lines."""
    ordered = log.orderBy("sequence_number")
    ordered.write.csv(to, header=True, escape='"') if kind == "csv" else ordered.write.json(to)


def policy_rules(rules: DataFrame) -> list[tuple]:
    """The rules of a policy file, few enough for the driver."""
    return [(r.rule, r.mode, r.kind, r.argument, r.threshold) for r in rules.collect()]


def violations(facts: DataFrame, rules: list[tuple]) -> DataFrame:
    """scan_id, rule, mode and violated of every scan and rule: a rule is violated if one of its conditions holds."""
    by_rule: dict[tuple[str, str], Column] = {}
    for rule, mode, kind, argument, threshold in rules:
        met = condition(kind, argument, threshold)
        by_rule[rule, mode] = by_rule[rule, mode] | met if (rule, mode) in by_rule else met
    each = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(m).alias("mode"), c.alias("violated")) for (r, m), c in by_rule.items()))
    return facts.select("scan_id", F.explode(each).alias("p")).select("scan_id", "p.*")


@query("src01_json_store", "SELECT scan_id, status, total, raw_score FROM scans")
def src01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document a scan, and one that does not parse, read as a store."""
    to = shared_path(spark, "json-store")
    rows = scans(findings(spark, sf_dir)).select(F.concat("scan_id", F.lit(".json")).alias("name"), F.to_json(F.struct("scan_id", "status", "total", "raw_score")).alias("content"))
    replace_files(rows.unionByName(spark.createDataFrame([("broken.json", '{"scan_id": ')], "name string, content string")), to)
    return json_store(spark, to, SCAN).drop("modified")


@query("snk02_atomic_replace", "SELECT scan_id, 'archived' AS status, total, raw_score FROM scans")
def snk02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store whose documents are all written twice: the second ones are read, and nothing is left of the first."""
    to = shared_path(spark, "json-store")
    for status in ("completed", "archived"):
        replace_files(scans(findings(spark, sf_dir)).select(F.concat("scan_id", F.lit(".json")).alias("name"), F.to_json(F.struct("scan_id", F.lit(status).alias("status"), "total", "raw_score")).alias("content")), to)
    return json_store(spark, to, SCAN).drop("modified")


@query("src03_sqlite", "SELECT scan_id, status, updated_at FROM (SELECT scan_id, CASE WHEN raw_score >= 500 THEN 'failed' ELSE 'completed' END AS status, cast(epoch_us(end_time) as bigint) AS updated_at FROM scans) WHERE status = 'completed' ORDER BY updated_at DESC, scan_id LIMIT 50 OFFSET 5")
def src03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans in one SQLite file a repository: those completed, newest first, one page."""
    to = shared_path(spark, "sqlite")
    status = F.when(F.col("raw_score") >= 500, "failed").otherwise("completed")
    rows = scans(findings(spark, sf_dir)).select("name", "scan_id", status.alias("status"), F.unix_micros(F.col("end_time").cast("timestamp")).alias("updated_at"))
    replace_files(sqlite_files(rows, "name", "scans", ("scan_id", "status", "updated_at")), to)
    read = sqlite_table(spark, to, "SELECT scan_id, status, updated_at FROM scans WHERE status = 'completed'", "scan_id string, status string, updated_at long")
    return read.orderBy(F.desc("updated_at"), "scan_id").offset(5).limit(50)


@query("src05_tree_walk", "SELECT 'd' || p_size % 4 || '/' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.JS' ELSE '.go' END AS file, length(p_name) AS chars FROM part WHERE p_partkey % 4 < 3 AND p_partkey % 7 <> 0 UNION ALL SELECT 'd0/Makefile', 4")
def src05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree with files of other extensions, large ones and one without an extension."""
    to = shared_path(spark, "tree")
    k = F.col("p_partkey")
    extension = F.when(k % 4 == 0, ".py").when(k % 4 == 1, ".JS").when(k % 4 == 2, ".go").otherwise(".png")
    text = F.when(k % 7 == 0, F.repeat(F.lit("x"), F.lit(2000))).otherwise(F.col("p_name"))  # above the size below
    files = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name"), "p_partkey").select(F.concat(F.lit("d"), (F.col("p_size") % 4).cast("string"), F.lit("/"), k.cast("string"), extension).alias("name"), text.alias("content"))
    replace_files(files.unionByName(spark.createDataFrame([("d0/Makefile", "all:"), ("d0/README", "no")], "name string, content string")), to)
    read = source_files(spark, to, (".py", ".js", ".go"), 1000)
    return read.select(F.regexp_extract("path", r"(d\d/[^/]+)$", 1).alias("file"), F.length("text").cast("long").alias("chars"))


@query("src06_zip", "SELECT p_brand AS archive, count(*) AS members, cast(sum(length(p_name)) as bigint) AS chars FROM part GROUP BY 1")
def src06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives that also hold members that would leave the folder; these are not read."""
    to = shared_path(spark, "zips")
    part = table(spark, sf_dir, "part").select("p_brand", F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), F.lit(".txt")).alias("member"), F.col("p_name").alias("body"))
    bad = part.select("p_brand").distinct().select("p_brand", F.explode(F.array(F.lit("../outside.txt"), F.lit("/absolute.txt"), F.lit("a/../../b.txt"))).alias("member"), F.lit("bad").alias("body"))
    replace_files(zip_files(part.unionByName(bad), "p_brand", "member", "body"), to)
    out = unzipped(spark, to)
    return out.groupBy(F.regexp_extract("archive", r"([^/]+)\.zip$", 1).alias("archive")).agg(F.count("*").alias("members"), F.sum(F.length("content")).cast("long").alias("chars"))


@query("src13_category", "SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'Named Weakness' WHEN 1 THEN 'SQL Injection' WHEN 2 THEN 'Cross-site Scripting' WHEN 3 THEN 'Command Injection' WHEN 4 THEN 'Secret Leak' WHEN 5 THEN 'Cryptographic Issue' WHEN 6 THEN 'Path Traversal' WHEN 7 THEN p_name || ' is bad' ELSE 'Security Issue' END AS category FROM part")
def src13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check's category: a weakness's name, else the first word that its id has, else its message's first sentence."""
    k = F.col("p_partkey") % 9
    check = F.element_at(F.array(*map(F.lit, ("py.sql.x", "PY.SQL-XSS", "js.xss.exec", "py.exec.password", "py.Password.hash", "py.hash.path", "py.path-traversal", "py.other", "py.other"))), k.cast("int") + 1)
    message = F.when(k == 7, F.concat("p_name", F.lit(" is bad. More follows"))).otherwise(F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", category_of(check, message, F.when(k == 0, F.lit("Named Weakness"))).alias("category"))


@query("src16_bus_log", "SELECT event_id, message_type FROM bus_messages WHERE agent_id = 3 AND cast(ts as date) = DATE '2024-01-05' ORDER BY event_id LIMIT 1000")
def src16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day's messages of one agent from logs kept by day."""
    to = shared_path(spark, "bus")
    append_daily(bus_messages(spark, sf_dir), to)
    return daily_log(spark, to, "event_id long, agent_id long, message_type string", "2024-01-05").where("agent_id = 3").orderBy("event_id").limit(1000).select("event_id", "message_type")


@query("snk14_daily_append", "SELECT cast(cast(ts as date) as varchar) AS day, count(*) AS n, cast(sum(event_id) as bigint) AS ids FROM bus_messages GROUP BY 1")
def snk14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages appended in two writes, counted by day."""
    to = shared_path(spark, "bus")
    messages = bus_messages(spark, sf_dir)
    append_daily(messages.where("priority <= 2"), to)
    append_daily(messages.where("priority > 2"), to)
    return daily_log(spark, to, "event_id long").groupBy("day").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).select(F.col("day").cast("string").alias("day"), "n", "ids")


@query("src17_audit_log", "SELECT action, count(*) AS n, min(sequence_number) AS first, max(sequence_number) AS last FROM audit_log GROUP BY 1")
def src17(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = shared_path(spark, "audit")
    exported(audit_log(spark, sf_dir), to, "jsonl")
    read = spark.read.schema("sequence_number long, actor_id long, action string, details string").json(to)
    return read.groupBy("action").agg(F.count("*").alias("n"), F.min("sequence_number").alias("first"), F.max("sequence_number").alias("last"))


@query("snk09_audit_export", "SELECT kind, sequence_number, actor_id, action, details FROM audit_log CROSS JOIN (VALUES ('csv'), ('jsonl')) k(kind)")
def snk09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written in both forms and read again; details hold quotes and commas."""
    schema, out = "sequence_number long, actor_id long, action string, details string", None
    for kind in ("csv", "jsonl"):
        to = shared_path(spark, f"export-{kind}")
        exported(audit_log(spark, sf_dir).drop("timestamp"), to, kind)
        read = spark.read.schema(schema).csv(to, header=True, escape='"') if kind == "csv" else spark.read.schema(schema).json(to)
        read = read.select(F.lit(kind).alias("kind"), "*")
        out = read if out is None else out.unionByName(read)
    return out


_POLICY = {
    "name": "release gate",
    "rules": [
        {"id": "no-critical", "mode": "ERROR", "conditions": [{"type": "severity_count", "value": "CRITICAL", "count": 20}]},
        {"id": "injections", "mode": "WARN", "conditions": [{"type": "category_match", "value": "SQL Injection"}, {"type": "tool_match", "value": "gitleaks"}]},
        {"id": "risk", "mode": "ERROR", "conditions": [{"type": "min_risk_score", "count": 90}]},
    ],
}


@query("src18_policy_file", "SELECT * FROM (VALUES ('release gate', 'no-critical', 'ERROR', 'severity_count', 'CRITICAL', 20), ('release gate', 'injections', 'WARN', 'category_match', 'SQL Injection', 1), ('release gate', 'injections', 'WARN', 'tool_match', 'gitleaks', 1), ('release gate', 'risk', 'ERROR', 'min_risk_score', '', 90)) t(policy, rule, mode, kind, argument, threshold)")
def src18(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = shared_path(spark, "policy")
    replace_files(spark.createDataFrame([("policy.json", json.dumps(_POLICY, indent=1))], "name string, content string"), to)
    return policy_file(spark, to)


@query("sec18_policy_file", """WITH f AS (SELECT s.scan_id, s.critical, least(100, s.raw_score) AS risk, bool_or(x.category = 'SQL Injection') AS sqli, bool_or(x.tool_source = 'gitleaks') AS leak FROM scans s JOIN findings x USING (scan_id) GROUP BY ALL)
SELECT scan_id, 'no-critical' AS rule, 'ERROR' AS mode, critical >= 20 AS violated FROM f UNION ALL SELECT scan_id, 'injections', 'WARN', sqli OR leak FROM f UNION ALL SELECT scan_id, 'risk', 'ERROR', risk >= 90 FROM f""")
def sec18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scan against the rules of a policy file."""
    return violations(scan_facts(findings(spark, sf_dir)), policy_rules(src18(spark, sf_dir)))
