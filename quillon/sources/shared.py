"""Temporary tables and files of the engine's own queries, in the folder that the driver and the executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Folders that a task remembers to have made.
FOLDERS = 1000
_own: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in spark.checkpoint.dir (a temporary folder only where that is unset); removed when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="quillon-"))
    path = f"{base.rstrip('/')}/quillon/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read from there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit; nothing else depends on this
        return


def resolved(spark: SparkSession, path: str) -> str:
    """A path with the scheme that Spark would read it by, for writers that do not go through Spark."""
    if "://" in path or path.startswith("file:"):
        return path
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def opened(target: str) -> tuple[object, str]:
    """Arrow's file system of a resolved path, and the path there; for tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(target if "://" in target else target.replace("file:/", "file:///", 1))


def replace_files(df: DataFrame, to: str, name: str = "name", content: str = "content") -> None:
    """Write one file for each row: under a temporary name first, then renamed, so that readers see the old file or the new one.

    A task that runs twice writes the same file again. Rows of equal name overwrite each other in no set order.
    """
    target = resolved(df.sparkSession, to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(target)
        system.create_dir(base, recursive=True)
        made: set[str] = set()
        for batch in batches:
            for file, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder = file.rpartition("/")[0]
                if folder and folder not in made:
                    system.create_dir(f"{base}/{folder}", recursive=True)
                    made = {folder} if len(made) >= FOLDERS else made | {folder}
                temporary = f"{base}/.{file.replace('/', '_')}.{uuid.uuid4().hex}.tmp"
                with system.open_output_stream(temporary) as f:
                    f.write(body)
                system.move(temporary, f"{base}/{file}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    df.selectExpr(f"cast({name} as string) AS name", f"cast({content} as binary) AS content").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
