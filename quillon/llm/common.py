"""What the operators of this subpackage share: tables, the shared folder, written intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark's reader whatever the path's scheme."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="quillon-shared-"))
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the application ends."""
    path = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """A path as a URI of the file system that Spark would read it by, for writers that do not go through Spark; a bare path belongs to the cluster's default one."""
    if "://" not in path and not path.startswith("file:"):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return path if "://" in path else path.replace("file:", "file://", 1)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system; a stopped session is ignored."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit; nothing else depends on this
        return


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df as a table in the shared folder, read again: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quillon_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Give the disk of a written table back once nothing reads it any more."""
    remove(df.sparkSession, df.quillon_path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts small; never raises a smaller setting of the session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= rows:
        spark.conf.set(key, str(rows))


def pieces(batches: Iterable[pa.RecordBatch], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece has about most bytes, or one row: what a task holds follows the texts' size, not their number."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > 2 * most:
                n = -(-n // 2)
            yield batch.slice(at, n)
            at += n


#: Words of 64 bits in a filter of ids; it has this many rows at most, whatever the number of ids.
FILTER_WORDS = 1 << 18


def with_possible(df: DataFrame, key: str, ids: DataFrame, name: str = "possible") -> DataFrame:
    """df with a flag that is true for every row whose key is in ids (one column), and false for almost all others.

    The ids are hashed to bits of a table of at most FILTER_WORDS rows, which is what is broadcast. With more ids than
    bits the flag says less, but rows that it clears are never in ids.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_WORDS * 64))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), {FILTER_WORDS * 64}) % 64 as int))")
    words = ids.select(F.col(ids.columns[0]).alias(key)).select(F.floor(place / 64).alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    joined = df.withColumn("__word", F.floor(place / 64)).join(F.broadcast(words), "__word", "left")
    return joined.withColumn(name, F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__word", "__bits")


def text_bytes(df: DataFrame, text: str = "text") -> "F.Column":
    """The text as UTF-8 bytes; null becomes empty."""
    return F.coalesce(df[text], F.lit("")).cast("binary")
