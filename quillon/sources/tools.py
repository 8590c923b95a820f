"""Outputs of scanners, lock files, archives, logs and policy files as tables."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.plans.fixtures import findings
from quillon.sources.readers import cvss_band_closed, level_of, masked_secret, semgrep_findings
from quillon.sources.tables import table

COLUMNS = ("tool_source", "rule", "file_path", "line_number", "severity", "message", "cwe_id")


def _rows(df: DataFrame, raw: str, schema: str, path: str, tool: str, **columns: Column) -> DataFrame:
    """The exploded rows of a tool's JSON with the common columns; what does not parse gives no rows."""
    parsed = df.select(F.explode(F.from_json(raw, schema)[path] if path else F.from_json(raw, schema)).alias("r"))
    given = {"tool_source": F.lit(tool), "cwe_id": F.lit(None).cast("string"), "line_number": F.lit(None).cast("int")} | columns
    return parsed.select(*(given[c].alias(c) for c in COLUMNS))


def bandit(df: DataFrame, raw: str = "json") -> DataFrame:
    schema = "struct<results:array<struct<test_id:string,filename:string,line_number:int,issue_severity:string,issue_text:string,issue_cwe:struct<id:int>>>>"
    return _rows(df, raw, schema, "results", "bandit", rule=F.col("r.test_id"), file_path=F.col("r.filename"), line_number=F.col("r.line_number"), severity=level_of(F.col("r.issue_severity")), message=F.col("r.issue_text"), cwe_id=F.concat(F.lit("CWE-"), F.col("r.issue_cwe.id").cast("string")))


def eslint(df: DataFrame, raw: str = "json") -> DataFrame:
    """A message for each file; severity 2 is HIGH, 1 MEDIUM."""
    parsed = df.select(F.explode(F.from_json(raw, "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,message:string,line:int>>>>")).alias("f")).select("f.filePath", F.explode("f.messages").alias("r"))
    severity = F.when(F.col("r.severity") == 2, "HIGH").when(F.col("r.severity") == 1, "MEDIUM").otherwise("INFO")
    given = {"tool_source": F.lit("eslint"), "rule": F.col("r.ruleId"), "file_path": F.col("filePath"), "line_number": F.col("r.line"), "severity": severity, "message": F.col("r.message"), "cwe_id": F.lit(None).cast("string")}
    return parsed.select(*(given[c].alias(c) for c in COLUMNS))


def pylint(df: DataFrame, raw: str = "json") -> DataFrame:
    return _rows(df, raw, "array<struct<type:string,symbol:string,path:string,line:int,message:string>>", "", "pylint", rule=F.col("r.symbol"), file_path=F.col("r.path"), line_number=F.col("r.line"), severity=level_of(F.col("r.type")), message=F.col("r.message"))


def pmd(df: DataFrame, raw: str = "json") -> DataFrame:
    """Violations of each file; priority 1 is CRITICAL, 5 INFO."""
    parsed = df.select(F.explode(F.from_json(raw, "struct<files:array<struct<filename:string,violations:array<struct<beginline:int,rule:string,priority:int,description:string>>>>>")["files"]).alias("f")).select("f.filename", F.explode("f.violations").alias("r"))
    severity = F.element_at(F.array(*map(F.lit, ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"))), F.least(F.lit(5), F.greatest(F.lit(1), "r.priority")))
    given = {"tool_source": F.lit("pmd"), "rule": F.col("r.rule"), "file_path": F.col("filename"), "line_number": F.col("r.beginline"), "severity": severity, "message": F.col("r.description"), "cwe_id": F.lit(None).cast("string")}
    return parsed.select(*(given[c].alias(c) for c in COLUMNS))


def gitleaks(df: DataFrame, raw: str = "json") -> DataFrame:
    """Leaks, with the secret masked."""
    return _rows(df, raw, "array<struct<RuleID:string,File:string,StartLine:int,Secret:string>>", "", "gitleaks", rule=F.col("r.RuleID"), file_path=F.col("r.File"), line_number=F.col("r.StartLine"), severity=F.lit("CRITICAL"), message=masked_secret(F.col("r.Secret")), cwe_id=F.lit("CWE-798"))


def dependency_check(df: DataFrame, raw: str = "json") -> DataFrame:
    """A row for each vulnerability of each dependency; severity by closed CVSS bands."""
    schema = "struct<dependencies:array<struct<fileName:string,vulnerabilities:array<struct<name:string,description:string,cvssv3:struct<baseScore:double>,cwes:array<string>>>>>>"
    parsed = df.select(F.explode(F.from_json(raw, schema)["dependencies"]).alias("d")).select("d.fileName", F.explode("d.vulnerabilities").alias("r"))
    given = {"tool_source": F.lit("dependency_check"), "rule": F.col("r.name"), "file_path": F.col("fileName"), "line_number": F.lit(None).cast("int"), "severity": cvss_band_closed(F.col("r.cvssv3.baseScore")), "message": F.col("r.description"), "cwe_id": F.get("r.cwes", F.lit(0))}
    return parsed.select(*(given[c].alias(c) for c in COLUMNS))


def _pairs(lines: Column, pattern: str) -> Column:
    hit = F.filter(lines, lambda x: x.rlike(pattern))
    return F.transform(hit, lambda x: F.struct(F.lower(F.regexp_extract(x, pattern, 1)).alias("name"), F.regexp_extract(x, pattern, 2).alias("version")))


def lock_file(name: Column, text: Column) -> Column:
    """Names and versions in a lock file, by the file's name; null for files of other names."""
    lines = F.split(text, "\n")
    package = F.transform(F.map_entries(F.from_json(text, "struct<packages:map<string,struct<version:string>>>")["packages"]), lambda e: F.struct(F.lower(F.regexp_extract(e["key"], r"node_modules/(.+)$", 1)).alias("name"), e["value"]["version"].alias("version")))
    composer = F.transform(F.from_json(text, "struct<packages:array<struct<name:string,version:string>>>")["packages"], lambda p: F.struct(F.lower(p["name"]).alias("name"), p["version"].alias("version")))
    pipfile = F.transform(F.map_entries(F.from_json(text, "struct<default:map<string,struct<version:string>>>")["default"]), lambda e: F.struct(F.lower(e["key"]).alias("name"), F.regexp_replace(e["value"]["version"], "^==", "").alias("version")))
    blocks = F.regexp_extract_all(text, F.lit(r'name = "([^"]+)"\s+version = "([^"]+)"'), 0)
    toml = _pairs(blocks, r'name = "([^"]+)"\s+version = "([^"]+)"')
    maven = _pairs(F.regexp_extract_all(text, F.lit(r"<artifactId>[^<]+</artifactId>\s*<version>[^<$]+</version>"), 0), r"<artifactId>([^<]+)</artifactId>\s*<version>([^<]+)</version>")
    return (
        F.when(name.endswith("package-lock.json"), F.filter(package, lambda p: p["name"] != "")).when(name.endswith("composer.lock"), composer).when(name.endswith("Pipfile.lock"), pipfile).when(name.endswith("poetry.lock") | name.endswith("Cargo.lock"), toml)
        .when(name.endswith("pom.xml"), maven).when(name.endswith("go.mod"), _pairs(lines, r"^\s*(?:require\s+)?([\w./-]+\.[\w./-]+)\s+v([^\s]+)")).when(name.endswith("build.gradle"), _pairs(lines, r"""['"]([\w.-]+:[\w.-]+):([\w.-]+)['"]""")).when(name.endswith("requirements.txt"), _pairs(lines, r"^\s*([A-Za-z0-9._-]+)\s*==\s*([^\s#;]+)"))
    )


def unzipped(spark: SparkSession, path: str, most_bytes: int = 100 << 20) -> DataFrame:
    """archive, path and content of the members of zip files; members that would leave the folder are skipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive, content in zip(b["path"], b["content"]):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.infolist():
                        p = PurePosixPath(m.filename.replace("\\", "/"))
                        if not m.is_dir() and not p.is_absolute() and ".." not in p.parts and m.file_size <= most_bytes:
                            rows.append((archive, str(p), z.read(m)))
                yield pd.DataFrame(rows, columns=["archive", "path", "content"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content").mapInPandas(run, "archive string, path string, content binary")


def policy_file(spark: SparkSession, path: str) -> DataFrame:
    """A policy's rules and conditions as rows: policy, rule, mode, kind, argument, threshold."""
    doc = json.loads("\n".join(r.value for r in spark.read.text(path).collect()))  # one small file
    rows = [(doc["name"], r["id"], r.get("mode", "ERROR"), c["type"], str(c.get("value", "")), int(c.get("count", 1))) for r in doc.get("rules", []) for c in r.get("conditions", [])]
    return spark.createDataFrame(rows, "policy string, rule string, mode string, kind string, argument string, threshold int")


def daily_log(spark: SparkSession, path: str, schema: str, day: str | None = None) -> DataFrame:
    """JSON lines kept in a folder for each day; a day's filter reads only its folder."""
    df = spark.read.schema(f"{schema}, day string").json(path)
    return df if day is None else df.where(F.col("day") == day)


def append_daily(df: DataFrame, path: str, ts: str = "ts") -> None:
    df.withColumn("day", F.date_format(ts, "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(path)


@query("src09_parsed_outputs", "SELECT tool_source, severity, count(*) AS n FROM findings WHERE tool_source = 'bandit' GROUP BY 1, 2")
def src09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings written as one tool's JSON for each scan and parsed again."""
    item = F.struct(F.col("category").alias("test_id"), F.col("file_path").alias("filename"), "line_number", F.col("severity").alias("issue_severity"), F.col("id").alias("issue_text"))
    raw = findings(spark, sf_dir).where("tool_source = 'bandit'").groupBy("scan_id").agg(F.to_json(F.struct(F.collect_list(item).alias("results"))).alias("json"))
    return bandit(raw).groupBy("tool_source", "severity").agg(F.count("*").alias("n"))


_ALL_TOOLS = ("bandit", "eslint", "pylint", "pmd", "gitleaks", "dependency_check", "semgrep")
_SPOKEN = {  # a finding's severity as each tool puts it, as an expression and as what its parser makes of that
    "bandit": ("severity", "severity"), "eslint": ("CASE severity WHEN 'CRITICAL' THEN 2 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END", "CASE severity WHEN 'CRITICAL' THEN 'HIGH' WHEN 'HIGH' THEN 'HIGH' WHEN 'MEDIUM' THEN 'MEDIUM' ELSE 'INFO' END"),
    "pylint": ("CASE severity WHEN 'CRITICAL' THEN 'fatal' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' WHEN 'LOW' THEN 'refactor' ELSE 'convention' END", "severity"), "pmd": ("CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 4 ELSE 5 END", "severity"),
    "gitleaks": ("severity", "'CRITICAL'"), "dependency_check": ("CASE severity WHEN 'CRITICAL' THEN 9.5D WHEN 'HIGH' THEN 7.5D WHEN 'MEDIUM' THEN 5.0D WHEN 'LOW' THEN 2.0D ELSE 0.0D END", "severity"), "semgrep": ("CASE severity WHEN 'CRITICAL' THEN 'CRITICAL' WHEN 'HIGH' THEN 'ERROR' WHEN 'MEDIUM' THEN 'WARNING' WHEN 'LOW' THEN 'NOTE' ELSE 'INFO' END", "severity"),
}


def tool_outputs(found: DataFrame) -> DataFrame:
    """scan_id, tool and json: a scan's findings as the outputs of seven tools, which take them by turns of the line number."""
    level = F.expr("CASE line_number % 7 " + " ".join(f"WHEN {i} THEN cast({_SPOKEN[t][0]} AS string)" for i, t in enumerate(_ALL_TOOLS)) + " END")
    rows = found.select("scan_id", "id", "file_path", "line_number", "category", level.alias("level"), F.element_at(F.array(*map(F.lit, _ALL_TOOLS)), F.col("line_number") % 7 + 1).alias("tool"))
    number = F.col("level").cast("int")
    item = {
        "bandit": F.struct(F.col("category").alias("test_id"), F.col("file_path").alias("filename"), "line_number", F.col("level").alias("issue_severity"), F.col("id").alias("issue_text")),
        "eslint": F.struct(F.col("file_path").alias("filePath"), F.array(F.struct(F.col("category").alias("ruleId"), number.alias("severity"), F.col("id").alias("message"), F.col("line_number").alias("line"))).alias("messages")),
        "pylint": F.struct(F.col("level").alias("type"), F.col("category").alias("symbol"), F.col("file_path").alias("path"), F.col("line_number").alias("line"), F.col("id").alias("message")),
        "pmd": F.struct(F.col("file_path").alias("filename"), F.array(F.struct(F.col("line_number").alias("beginline"), F.col("category").alias("rule"), number.alias("priority"), F.col("id").alias("description"))).alias("violations")),
        "gitleaks": F.struct(F.col("category").alias("RuleID"), F.col("file_path").alias("File"), F.col("line_number").alias("StartLine"), F.col("id").alias("Secret")),
        "dependency_check": F.struct(F.col("file_path").alias("fileName"), F.array(F.struct(F.col("category").alias("name"), F.col("id").alias("description"), F.struct(F.col("level").cast("double").alias("baseScore")).alias("cvssv3"))).alias("vulnerabilities")),
        "semgrep": F.struct(F.col("category").alias("check_id"), F.col("file_path").alias("path"), F.struct(F.col("line_number").alias("line")).alias("start"), F.struct(F.col("id").alias("message"), F.col("level").alias("severity")).alias("extra")),
    }
    wrapped = {"bandit": "results", "pmd": "files", "dependency_check": "dependencies", "semgrep": "results"}
    out = None
    for tool in _ALL_TOOLS:
        items = F.collect_list(item[tool])  # a tool writes one document for each scan
        own = rows.where(F.col("tool") == tool).groupBy("scan_id", "tool").agg(F.to_json(F.struct(items.alias(wrapped[tool])) if tool in wrapped else items).alias("json"))
        out = own if out is None else out.unionByName(own)
    return out


def all_findings(outputs: DataFrame) -> DataFrame:
    """The common columns of every finding in outputs of any of the seven tools."""
    own = lambda t: outputs.where(F.col("tool") == t)
    semgrep = semgrep_findings(own("semgrep"))
    out = semgrep.select(F.lit("semgrep").alias("tool_source"), F.col("check_id").alias("rule"), "file_path", "line_number", "severity", F.col("category").alias("message"), "cwe_id")
    for tool, parser in (("bandit", bandit), ("eslint", eslint), ("pylint", pylint), ("pmd", pmd), ("gitleaks", gitleaks), ("dependency_check", dependency_check)):
        out = out.unionByName(parser(own(tool)))
    return out


@query("src09_all_tools", " UNION ALL ".join(f"SELECT '{t}' AS tool_source, category AS rule, {_SPOKEN[t][1]} AS severity, count(*) AS n, count(DISTINCT file_path) AS files FROM findings WHERE line_number % 7 = {i} GROUP BY ALL" for i, t in enumerate(_ALL_TOOLS)))
def src09_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings written as the documents of seven tools and parsed again."""
    return all_findings(tool_outputs(findings(spark, sf_dir))).groupBy("tool_source", "rule", "severity").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files"))


@query("src15_lock_files", "SELECT p_brand AS project, count(*) AS dependencies, count(DISTINCT p_size) AS versions FROM part GROUP BY 1")
def src15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as requirements files, one for each brand, and parsed again."""
    line = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("=="), F.col("p_size").cast("string"))
    files = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("project")).agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    rows = files.select("project", F.explode(lock_file(F.lit("requirements.txt"), F.col("text"))).alias("d"))
    return rows.groupBy("project").agg(F.count("*").alias("dependencies"), F.count_distinct("d.version").alias("versions"))


@query("src11_levels", "SELECT severity, count(*) AS n FROM findings GROUP BY 1")
def src11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools' words for a severity, normalised."""
    return findings(spark, sf_dir).groupBy(level_of(F.lower("severity")).alias("severity")).agg(F.count("*").alias("n"))
