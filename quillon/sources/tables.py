"""Readers for the parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table by name; every path goes through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys over as many tasks as a shuffle has.

    A table that is small on disk is one task to Spark, or a few, however much is made of each row: a file of text, say. The
    number is explicit, so that adaptive plans do not join the tasks again, whose rows say little about the work that follows.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)
