"""Readers: JSON stores, source trees, tool outputs, lock files, page and key lookups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.plans.fixtures import findings, scans
from quillon.sources.shared import kept, opened, resolved
from quillon.sources.tables import dealt, table

#: tools' words for a severity; bands of CVSS scores.
LEVELS = {"error": "HIGH", "warning": "MEDIUM", "note": "LOW", "info": "INFO", "critical": "CRITICAL", "high": "HIGH", "medium": "MEDIUM", "moderate": "MEDIUM", "low": "LOW", "style": "INFO", "convention": "INFO", "refactor": "LOW", "fatal": "CRITICAL"}
#: Words of a check's name in order of precedence and the category that they mean.
CATEGORY_WORDS = ((("sql",), "SQL Injection"), (("xss",), "Cross-site Scripting"), (("command", "exec"), "Command Injection"), (("secret", "password"), "Secret Leak"), (("crypto", "hash"), "Cryptographic Issue"), (("traversal", "path"), "Path Traversal"), (("ssrf",), "Server-Side Request Forgery"))
#: Files without an extension that are read all the same.
BARE = ("Dockerfile", "Makefile", "Gemfile", "Rakefile")
#: Entries of a folder in an Arrow batch; bytes of files in one, but for the last file.
LISTED, READ = 10_000, 16 << 20


def json_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file; files that do not parse are skipped."""
    df = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.select("*", F.col("_metadata.file_modification_time").alias("modified")).where("_corrupt IS NULL").drop("_corrupt")


def source_files(spark: SparkSession, path: str, extensions: tuple[str, ...], most_bytes: int = 10 << 20) -> DataFrame:
    """path and text of the files of a tree with one of the extensions, or a known name without one, none empty or above a size.

    Folders are listed by tasks, one level of the tree a round, and the files wanted are dealt over the tasks of a shuffle: a
    reader of whole files lists them in the driver and makes a task of every few of them.
    """
    files = tree_files(spark, path)
    bare = F.regexp_extract(F.col("path"), r"([^/]+)$", 1).isin(*BARE)
    wanted = files.where(F.col("length").between(1, most_bytes) & (extension_of(F.col("path")).isin(*extensions) | bare))
    return file_contents(dealt(wanted.select("path"), "path"), resolved(spark, path)).select("path", F.decode("content", "UTF-8").alias("text"))


def tree_files(spark: SparkSession, path: str) -> DataFrame:
    """path and length of all files of a tree but hidden ones, by Spark's rule. A folder is listed by one task."""
    target = resolved(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = opened(target)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [i for i in system.get_file_info(fs.FileSelector(base + folder[len(target) :])) if not _hidden(i.base_name)]
                for at in range(0, len(found), LISTED):
                    some = found[at : at + LISTED]
                    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{i.base_name}" for i in some], pa.string()), pa.array([i.size for i in some], pa.int64()), pa.array([i.type == fs.FileType.Directory for i in some], pa.bool_())], names=["path", "length", "folder"])

    level, out = spark.createDataFrame([(target,)], "path string"), None
    while True:
        listed = kept(level.mapInArrow(run, "path string, length long, folder boolean"), "tree")
        files, folders = listed.where("NOT folder").select("path", "length"), listed.where("folder").select("path")
        out = files if out is None else out.unionByName(files)
        if folders.isEmpty():
            return out
        level = dealt(folders, "path")


def _hidden(name: str) -> bool:
    return (name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name) and not name.startswith(("_metadata", "_common_metadata"))


def file_contents(paths: DataFrame, target: str) -> DataFrame:
    """path and content of files below a resolved path, in Arrow batches of bounded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(target)
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.binary())], names=["path", "content"])
        for batch in batches:
            rows, size = [], 0
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(base + path[len(target) :]) as f:
                    rows.append((path, f.read()))
                size += len(rows[-1][1])
                if size >= READ:
                    yield made(rows)
                    rows, size = [], 0
            yield made(rows)

    return paths.select("path").mapInArrow(run, "path string, content binary")


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def numbered_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line, numbered from 1."""
    return df.select("*", F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line_number", F.col("pos") + 1).drop("pos")


def snippet(text: Column, line: Column, around: int = 3) -> Column:
    """The lines around one, numbered, with a mark at it."""
    lines = F.split(text, "\n")
    first = F.greatest(F.lit(1), line - around)
    part = F.slice(lines, first, F.least(F.size(lines), line + around) - first + 1)
    return F.array_join(F.transform(part, lambda x, i: F.concat(F.when(i + first == line, ">>> ").otherwise("    "), F.format_string("%4d", i + first), F.lit(": "), x)), "\n")


def cvss_band(score: Column) -> Column:
    return F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").when(score > 0, "LOW").otherwise("INFO")


def cvss_band_closed(score: Column) -> Column:
    """Closed bands; a score in a gap between two of them is MEDIUM."""
    return F.when(score.between(9.0, 10.0), "CRITICAL").when(score.between(7.0, 8.9), "HIGH").when(score.between(4.0, 6.9), "MEDIUM").when(score.between(0.1, 3.9), "LOW").when(score == 0, "INFO").otherwise("MEDIUM")


def masked_secret(text: Column) -> Column:
    """Nothing: a fixed mark; up to 8 characters: stars; else the first and last three with stars between."""
    n = F.length(text)
    return F.when(F.coalesce(n, F.lit(0)) == 0, "[REDACTED]").when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(text, F.lit(3)), F.repeat(F.lit("*"), n - 6), F.right(text, F.lit(3))))


def category_of(check: Column, message: Column, cwe_name: Column | None = None) -> Column:
    """A weakness's name if there is one, else what the check's id says, else the message's first sentence."""
    out = None if cwe_name is None else F.when(F.coalesce(cwe_name, F.lit("")) != "", cwe_name)
    for words, category in CATEGORY_WORDS:
        hit = F.lower(check).rlike("|".join(words))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.when(F.coalesce(message, F.lit("")) != "", F.substring(F.split_part(message, F.lit("."), F.lit(1)), 1, 80)).otherwise("Security Issue")


def level_of(word: Column) -> Column:
    out = None
    for k, v in LEVELS.items():
        out = F.when(F.lower(word) == k, v) if out is None else out.when(F.lower(word) == k, v)
    return out.otherwise("INFO")


SEMGREP = "results array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<message:string,severity:string,metadata:struct<cwe:array<string>>>>>"


def semgrep_findings(df: DataFrame, raw: str = "json") -> DataFrame:
    """A row for each result of a tool's JSON output."""
    r = df.withColumn("r", F.explode(F.from_json(raw, f"struct<{SEMGREP.replace(' array', ':array', 1)}>")["results"]))
    cwe = F.regexp_extract(F.coalesce(F.get("r.extra.metadata.cwe", F.lit(0)), F.lit("")), r"CWE-(\d+)", 1)
    return r.select(F.col("r.check_id").alias("check_id"), F.col("r.path").alias("file_path"), F.col("r.start.line").alias("line_number"), level_of(F.col("r.extra.severity")).alias("severity"), category_of(F.col("r.check_id"), F.col("r.extra.message")).alias("category"), F.when(cwe != "", F.concat(F.lit("CWE-"), cwe)).alias("cwe_id"))


def requirements(text: Column) -> Column:
    """name and version of the pinned lines of a requirements file."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*[A-Za-z0-9._-]+\s*==\s*[^\s#;]+"))
    return F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, r"^\s*([A-Za-z0-9._-]+)", 1)).alias("name"), F.regexp_extract(x, r"==\s*([^\s#;]+)", 1).alias("version")))


def content_key(files: DataFrame, path: str = "path", text: str = "text", signature: str = "") -> DataFrame:
    """One SHA-256 over the sorted paths and contents and a configuration: a line of path and digest for each file, which is all that one task holds."""
    each = F.concat_ws(":", F.col(path), F.sha2(F.col(text).cast("binary"), 256))
    return files.select(each.alias("line")).agg(F.sha2(F.concat(F.array_join(F.sort_array(F.collect_list("line")), "\n"), F.lit(signature)), 256).alias("cache_key"))


@query("src02_list_scans", "SELECT scan_id, status FROM scans WHERE status='completed' ORDER BY end_time DESC, scan_id LIMIT 20 OFFSET 10")
def src02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans(findings(spark, sf_dir)).where("status = 'completed'").orderBy(F.desc("end_time"), "scan_id").offset(10).limit(20).select("scan_id", "status")


@query("src04_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 5 OR o_orderkey = 7")
def src04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey IN (5, 7)").select("o_orderkey", "o_totalprice")


@query("src07_lines", "SELECT doc_id, count(*) AS lines, cast(sum(length(line)) as bigint) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def src07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).groupBy("doc_id").agg(F.max("line_number").cast("long").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("src08_snippet", "SELECT doc_id, md5(array_to_string(list_transform((string_split(text, chr(10)))[1:3], lambda x, i: CASE WHEN i = 2 THEN '>>> ' ELSE '    ' END || lpad(cast(i as varchar), 4, ' ') || ': ' || x), chr(10))) AS snippet_md5 FROM documents")
def src08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(snippet(F.col("text"), F.lit(2), 1)).alias("snippet_md5"))


@query("src10_numbers", "SELECT doc_id, regexp_extract(text, '([0-9]{3,})', 1) AS number FROM documents WHERE regexp_matches(text, '[0-9]{3,}')")
def src10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]{3,}")).select("doc_id", F.regexp_extract("text", "([0-9]{3,})", 1).alias("number"))


@query("src12_cvss_bands", "SELECT CASE WHEN c >= 9 THEN 'CRITICAL' WHEN c >= 7 THEN 'HIGH' WHEN c >= 4 THEN 'MEDIUM' WHEN c > 0 THEN 'LOW' ELSE 'INFO' END AS open_band, CASE WHEN c BETWEEN 9.0 AND 10.0 THEN 'CRITICAL' WHEN c BETWEEN 7.0 AND 8.9 THEN 'HIGH' WHEN c BETWEEN 4.0 AND 6.9 THEN 'MEDIUM' WHEN c BETWEEN 0.1 AND 3.9 THEN 'LOW' WHEN c = 0 THEN 'INFO' ELSE 'MEDIUM' END AS closed_band, count(*) AS n FROM (SELECT round(l_tax * 125, 2) AS c FROM lineitem) GROUP BY 1, 2")
def src12(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.round(F.col("l_tax") * 125, 2)
    return table(spark, sf_dir, "lineitem").groupBy(cvss_band(c).alias("open_band"), cvss_band_closed(c).alias("closed_band")).agg(F.count("*").alias("n"))


@query("src14_masked", "SELECT p_partkey, CASE WHEN length(p_name) <= 8 THEN repeat('*', length(p_name)) ELSE left(p_name, 3) || repeat('*', length(p_name) - 6) || right(p_name, 3) END AS masked FROM part")
def src14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", masked_secret(F.col("p_name")).alias("masked"))


@query("src20_urls", "SELECT host, count(*) AS n FROM (SELECT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host FROM pages) WHERE host NOT IN ('', 'localhost', '127.0.0.1', '0.0.0.0') GROUP BY 1")
def src20(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1))
    return table(spark, sf_dir, "pages").select(host.alias("host")).where(~F.col("host").isin("", "localhost", "127.0.0.1", "0.0.0.0")).groupBy("host").agg(F.count("*").alias("n"))


@query("src19_cache_key", "SELECT sha256(array_to_string(list_sort(list(p_partkey || ':' || sha256(p_name))), chr(10)) || 'v1') AS cache_key FROM part")
def src19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_key(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_name").alias("text")), signature="v1")
