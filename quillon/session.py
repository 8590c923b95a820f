"""Session construction shared by the tests and the bench."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def get_session(cpus: int = 8, shuffle_partitions: int | None = None, app: str = "quillon") -> SparkSession:
    """A local session with the settings that the engine's operators expect.

    On a cluster the caller's own session is used as it is; only UTC matters for results.
    """
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="quillon-ckpt-"))
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
