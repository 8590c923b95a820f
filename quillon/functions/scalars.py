"""Scalar functions: paths, text, checksums, periods, complexity."""

from __future__ import annotations

import hashlib
import hmac
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.operators.aggregates import week_label
from quillon.sources.tables import table


def truncated(text: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - len(suffix))), F.lit(suffix))).otherwise(text)


def luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass the checksum."""
    n = F.length(digits)
    at = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 1, F.floor(at(i) * 2 / 10).cast("int") + at(i) * 2 % 10).otherwise(at(i))
    return n.between(13, 19) & (F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + value(i)) % 10 == 0)


def period_days(period: str) -> int:
    """Days of a period such as 30d, 4w or 3m."""
    m = re.fullmatch(r"(\d+)([dwm])", period.strip().lower())
    if not m:
        raise ValueError(f"no period: {period!r}")
    return int(m[1]) * {"d": 1, "w": 7, "m": 30}[m[2]]


def complexity(code: Column) -> Column:
    """Cyclomatic complexity by counting branches."""
    return F.regexp_count(code, F.lit(r"\b(?:if|elif|for|while|except|case|catch)\b|&&|\|\||\?")) + 1


def canonical_json_hash(df: DataFrame, columns: list[str], to: str = "record_hash") -> DataFrame:
    """SHA-256 of the columns as JSON text with sorted keys, in Arrow batches: the text form is Python's."""

    @F.pandas_udf("string")
    def run(rows: pd.DataFrame) -> pd.Series:
        return rows.apply(lambda r: hashlib.sha256(json.dumps({k: (v.item() if hasattr(v, "item") else v) for k, v in r.items()}, sort_keys=True).encode()).hexdigest(), axis=1)

    return df.withColumn(to, run(F.struct(*columns)))


def signed(df: DataFrame, payload: str, secret: str, to: str = "signature") -> DataFrame:
    """HMAC-SHA256 of a payload, which Spark has no function for."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else "sha256=" + hmac.new(secret.encode(), t.encode(), hashlib.sha256).hexdigest())

    return df.withColumn(to, run(F.col(payload)))


@query("scl19_levenshtein", "SELECT a.p_partkey AS a, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def scl19(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return p.alias("a").join(p.alias("b"), F.expr("b.p_partkey = a.p_partkey + 1")).select(F.col("a.p_partkey").alias("a"), F.levenshtein("a.p_name", "b.p_name").alias("distance"))


@query("scl20_normalised", "SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS text FROM benchmark")
def scl20(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators.dedup import normalised

    return table(spark, sf_dir, "benchmark").select("item_id", normalised(F.col("text")).alias("text"))


@query("scl22_luhn", "SELECT doc_id, digits, list_sum(list_transform(string_split(reverse(digits), ''), lambda x, i: CASE WHEN i % 2 = 0 THEN (2 * x::int) // 10 + (2 * x::int) % 10 ELSE x::int END)) % 10 = 0 AS valid FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{13,19}')) AS digits FROM documents)")
def scl22(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]{13,19}"), 0)).alias("digits"))
    return cards.select("doc_id", "digits", luhn(F.col("digits")).alias("valid"))


@query("scl25_week_label", "SELECT strftime(o_orderdate, '%Y-W%W') AS week, count(*) AS n FROM orders GROUP BY 1")
def scl25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(week_label(F.col("o_orderdate")).alias("week")).agg(F.count("*").alias("n"))


@query("scl26_paths", "SELECT page_id, lower(regexp_extract(url, '(\\.[a-z]+)$', 1)) AS extension, replace(regexp_extract(url, '://[^/]+/(.*)$', 1), '/', '.') AS dotted FROM pages")
def scl26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", r"(\.[a-z]+)$", 1)).alias("extension"), F.replace(F.regexp_extract("url", "://[^/]+/(.*)$", 1), F.lit("/"), F.lit(".")).alias("dotted"))


@query("scl27_truncated", "SELECT item_id, CASE WHEN length(text) > 60 THEN left(text, 57) || '...' ELSE text END AS short FROM benchmark")
def scl27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", truncated(F.col("text"), 60).alias("short"))


@query("scl31_record_hash", "SELECT event_id, sha256(concat_ws('|', cast(event_id as varchar), cast(user_id as varchar), event_type, props)) AS entry_hash FROM events")
def scl31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type", "props"), 256).alias("entry_hash"))


@query("scl32_json_hash", """SELECT event_id, sha256('{"event_id": ' || event_id || ', "event_type": "' || event_type || '", "props": "' || replace(props, '"', '\\"') || '"}') AS record_hash FROM events""")
def scl32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_json_hash(table(spark, sf_dir, "events").select("event_id", "event_type", "props"), ["event_id", "event_type", "props"]).select("event_id", "record_hash")


@query("scl33_signature")
def scl33(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signed(table(spark, sf_dir, "events").select("event_id", "props"), "props", "secret").select("event_id", "signature")


@query("scl34_json", "SELECT event_id, cast(json_extract(props, '$.k') as integer) AS k FROM events")
def scl34(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("scl38_complexity_all", "SELECT doc_id, len(regexp_extract_all(text, '\\b(?:if|elif|for|while|except|case|catch)\\b|&&|\\|\\||\\?')) + 1 AS complexity FROM documents")
def scl38_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", complexity(F.col("text")).cast("long").alias("complexity"))
