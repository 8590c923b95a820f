"""The graph of imports: which files import which, which modules come from outside, and what is reached from entry points.

Statements are read from one text at a time in Arrow batches; everything else is joins. An import names a file if the
file's path, without its ending and with dots for slashes, is the imported name, or that name without its last part (what
is imported from a module), or, for a folder, with ``__init__`` behind it. Relative imports are resolved by the importing
file's folder. Reach is searched in rounds: each joins the files that the round before has found with the edges, and drops
what was seen before.

Cases: texts that are null or do not parse import nothing; a file that imports itself has no edge; entry points that are no
files reach nothing; equal rows count once; an empty table gives no rows.
"""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.operators.syntax import each_text
from quillon.sources.shared import shared_path
from quillon.sources.tables import table


def imported(text: str) -> list[tuple[int, str, int]]:
    """Level (dots of a relative import), dotted name and line of everything that a text imports; a from-import is module and name."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [(0, a.name, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [(node.level, ".".join(x for x in (node.module, None if a.name == "*" else a.name) if x), node.lineno) for a in node.names]
    return out


def import_edges(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, name (absolute), to (the file that it names, or null) and line of every import."""
    found = each_text(files.select(path, text).distinct(), path, text, imported, ["level", "name", "line"], "level int, name string, line int")
    # a relative import of level n starts n - 1 folders above the file's own
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - F.col("level"), F.lit(0)))
    absolute = F.when(F.col("level") == 0, F.col("name")).otherwise(F.concat_ws(".", F.array_join(folders, "."), F.col("name")))
    names = found.select(path, F.regexp_replace(absolute, r"^\.", "").alias("name"), "line")
    module = F.replace(F.regexp_replace(path, r"(?:/__init__)?\.py$", ""), F.lit("/"), F.lit("."))
    modules = files.select(F.col(path).alias("to"), module.alias("module")).distinct()
    tried = names.select(path, "name", "line", F.posexplode(F.array("name", F.regexp_extract("name", r"^(.+)\.[^.]+$", 1))).alias("cut", "module")).where("module <> ''")
    hits = tried.join(modules, "module").groupBy(path, "name", "line").agg(F.min(F.struct("cut", "to")).alias("h"))
    return names.distinct().join(hits, [path, "name", "line"], "left").select(path, "name", F.col("h.to").alias("to"), "line")


def reach(edges: DataFrame, entries: DataFrame, path: str = "path") -> DataFrame:
    """path and distance of everything that entry points (one column) reach over edges (path, to), themselves included."""
    spark = edges.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        to = shared_path(spark, "reach")
        df.write.parquet(to)
        return spark.read.schema(df.schema).parquet(to)

    steps = kept(edges.where(F.col("to").isNotNull() & (F.col("to") != F.col(path))).select(path, "to").distinct())
    new = kept(entries.select(F.col(entries.columns[0]).alias(path)).distinct().withColumn("distance", F.lit(0)))
    seen, distance = new, 0
    while not new.isEmpty():
        distance += 1
        found = new.join(steps, path).select(F.col("to").alias(path)).distinct().join(seen, path, "left_anti")
        new = kept(found.withColumn("distance", F.lit(distance)))
        seen = seen.unionByName(new)
    return seen


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of files made from the parts: each imports two others and the one that imports it; every seventh imports nothing."""
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    text = F.concat(F.lit("import os\nimport app.core."), name(2 * k), F.lit("\nfrom . import "), name(2 * k + 1), F.lit("\nfrom app.core."), name(F.floor(k / 2)), F.lit(" import run as back\n"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("app/core/"), name(k), F.lit(".py")).alias("path"), F.when(k % 7 == 0, F.lit("x = 'import os'")).otherwise(text).alias("text"))


_TREE = "e AS (SELECT p_partkey AS k, v.name, v.line FROM part, LATERAL (VALUES ('os', 1), ('app.core.p' || 2 * p_partkey, 2), ('app.core.p' || (2 * p_partkey + 1), 3), ('app.core.p' || p_partkey // 2 || '.run', 4)) v(name, line) WHERE p_partkey % 7 <> 0)"


@query("sec06_import_edges", f"WITH {_TREE} SELECT 'app/core/p' || k || '.py' AS path, name, CASE WHEN t.p_partkey IS NULL THEN NULL ELSE 'app/core/p' || t.p_partkey || '.py' END AS \"to\", line FROM e LEFT JOIN part t ON regexp_matches(e.name, '^app') AND t.p_partkey = try_cast(regexp_extract(e.name, 'p([0-9]+)(\\.run)?$', 1) AS BIGINT)")
def sec06_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_edges(planted(spark, sf_dir))


@query("sec06_reach", "WITH RECURSIVE r AS (SELECT 1::BIGINT AS k, 0 AS distance UNION ALL SELECT t.p_partkey, r.distance + 1 FROM r JOIN part t ON r.k % 7 <> 0 AND (t.p_partkey IN (2 * r.k, 2 * r.k + 1) OR r.k = 1 AND t.p_partkey = 0)) SELECT 'app/core/p' || k || '.py' AS path, distance FROM r")
def sec06_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the first one reaches, and in how many steps."""
    return reach(import_edges(planted(spark, sf_dir)), spark.createDataFrame([("app/core/p1.py",)], "path string"))


@query("sec06_modules", f"WITH {_TREE} SELECT split_part(name, '.', 1) AS module, count(DISTINCT k) AS files, count(*) AS imports FROM e GROUP BY 1")
def sec06_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First parts of imported names, with the files that import them."""
    edges = import_edges(planted(spark, sf_dir))
    return edges.groupBy(F.split_part("name", F.lit("."), F.lit(1)).alias("module")).agg(F.count_distinct("path").alias("files"), F.count("*").alias("imports"))
