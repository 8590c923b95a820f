"""Row numbers, running sums, previous values and last marks within groups of any size.

A plain window puts a group into one task. Here rows are dealt into ranges of group and order, so a hot group is many
ranges; windows within a range give local results, one row for each range and group says what it carries on, and the
carried values of the ranges before are joined back. Only those rows, as many as ranges, meet in one task for a group.

Cases: a null group is a group; order has to be total within a group, or rows of equal order come in any order; nulls in a
summed column count as 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.shared import shared_path


def running(df: DataFrame, group: str, order: list[str], sums: tuple[str, ...] = (), previous: tuple[str, ...] = (), marks: tuple[str, ...] = ()) -> DataFrame:
    """df with row_no (from 1) and group_rows, and for each column named: sum_<c> up to the row, previous_<c> of the row before, and mark_<c>, the number of the last row so far (this one too) where c is true."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "ranges")
    df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    parts = spark.read.parquet(path)  # written: the ranges are sampled, and every pass has to see the same ones
    here = Window.partitionBy("__part", group).orderBy(*order)
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumns({"__no": F.row_number().over(here)} | {f"__sum_{c}": F.sum(F.coalesce(c, F.lit(0))).over(so_far) for c in sums} | {f"__lag_{c}": F.lag(c).over(here) for c in previous})
    local = local.withColumns({f"__mark_{c}": F.max(F.when(F.col(c), F.col("__no"))).over(so_far) for c in marks})
    at = F.struct(*order)
    totals = local.groupBy("__part", group).agg(F.count("*").alias("__rows"), *(F.sum(F.coalesce(c, F.lit(0))).alias(f"__all_{c}") for c in sums), *(F.max_by(F.struct(c), at).alias(f"__last_{c}") for c in previous), *(F.max(f"__mark_{c}").alias(f"__top_{c}") for c in marks))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumns({"__before": F.coalesce(F.sum("__rows").over(before), F.lit(0)), "group_rows": F.sum("__rows").over(Window.partitionBy(group))} | {f"__from_{c}": F.coalesce(F.sum(f"__all_{c}").over(before), F.lit(0)) for c in sums} | {f"__gone_{c}": F.last(f"__last_{c}").over(before) for c in previous})
    carried = carried.withColumns({f"__until_{c}": F.max(F.col("__before") + F.col(f"__top_{c}")).over(before) for c in marks})
    carried = carried.withColumnsRenamed({"__part": "__of", group: "__group"}).drop("__rows", *(f"__all_{c}" for c in sums), *(f"__last_{c}" for c in previous), *(f"__top_{c}" for c in marks))
    out = local.join(carried, (F.col("__part") == F.col("__of")) & F.col(group).eqNullSafe(F.col("__group")))
    found = [(F.col("__no") + F.col("__before")).alias("row_no"), F.col("group_rows")]
    found += [(F.col(f"__sum_{c}") + F.col(f"__from_{c}")).alias(f"sum_{c}") for c in sums]
    found += [F.when(F.col("__no") > 1, F.col(f"__lag_{c}")).otherwise(F.col(f"__gone_{c}")[c]).alias(f"previous_{c}") for c in previous]
    found += [F.coalesce(F.col("__before") + F.col(f"__mark_{c}"), F.col(f"__until_{c}")).alias(f"mark_{c}") for c in marks]
    return out.select(*df.columns, *found)


def ends_of(df: DataFrame, group: str, value: str, parts: int, order: list[str]) -> DataFrame:
    """group, n, first_mean and last_mean: means of a value over the first and the last of n div parts rows of each group."""
    rows = running(df.select(group, value, *(c for c in order if c not in (group, value))), group, order)
    share = F.floor(F.col("group_rows") / parts)
    mean = lambda c: F.avg(F.when(c, F.col(value)))
    return rows.groupBy(group).agg(F.max("group_rows").alias("n"), mean(F.col("row_no") <= share).alias("first_mean"), mean(F.col("row_no") > F.col("group_rows") - share).alias("last_mean"))
