"""Policies as an append-only table of changes: update, delete, list, read as of an earlier moment, compaction.

A change is a row of policy_id, seq (the total order of changes), at, op (create, update or delete) and the fields; a null
field of an update leaves what was there. A create replaces what there is, an update of nothing and a delete of a built-in
policy have no effect. Writers only ever append files, so readers need no locks, and a policy's state at any moment is an
aggregate over its changes up to then. Compaction writes each policy's state at a moment as one create, and the changes
after it as they are: reads as of that moment or later say the same.

Cases: changes of equal seq are one policy's or no order is promised; rows with a null id or seq are left out; a moment
before all changes has no policies; an empty table has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.sources.shared import shared_path
from quillon.sources.tables import table

FIELDS = ("name", "enabled", "mode", "scope_level")
#: Fixed value: policies of this prefix cannot be deleted.
BUILT_IN = "builtin-"


def append(changes: DataFrame, path: str) -> None:
    """Add changes to a table."""
    changes.select("policy_id", "seq", "at", "op", *FIELDS).write.mode("append").parquet(path)


def as_of(changes: DataFrame, moment: Column | None = None) -> DataFrame:
    """policy_id, version (changes since its create, that one included), seq and at of the last one, and the fields of every policy that there is at a moment (None: after all changes)."""
    known = changes.where("policy_id IS NOT NULL AND seq IS NOT NULL")
    known = known if moment is None else known.where(F.col("at") <= moment)
    gone = (F.col("op") == "delete") & ~F.col("policy_id").startswith(BUILT_IN)
    lives = known.groupBy("policy_id").agg(F.max(F.when(F.col("op") == "create", F.col("seq"))).alias("made"), F.max(F.when(gone, F.col("seq"))).alias("gone"))
    lives = lives.where("made IS NOT NULL AND (gone IS NULL OR gone < made)").select("policy_id", "made")
    own = known.where("op <> 'delete'").join(lives, "policy_id").where("seq >= made")
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return own.groupBy("policy_id").agg(F.count("*").alias("version"), F.max("seq").alias("seq"), F.max_by("at", "seq").alias("at"), *map(last, FIELDS))


def listed(policies: DataFrame, enabled_only: bool = False, scope_level: str | None = None) -> DataFrame:
    """Policies of a state, all or the enabled ones, of any scope or of one."""
    out = policies.where("enabled") if enabled_only else policies
    return out if scope_level is None else out.where(F.col("scope_level") == scope_level)


def compact(path: str, to: str, moment: Column, spark: SparkSession) -> None:
    """Write the table at path anew: one create for each policy that there is at the moment, and all later changes."""
    changes = spark.read.parquet(path)
    base = as_of(changes, moment).select("policy_id", "seq", "at", F.lit("create").alias("op"), *FIELDS)
    append(base.unionByName(changes.where(F.col("at") > moment).select(*base.columns)), to)


def changes_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes made from the orders."""
    k, p = F.col("o_orderkey"), F.col("o_custkey") % 40
    fields = {"name": F.when(k % 3 == 0, F.concat(F.lit("name "), k.cast("string"))), "enabled": F.when(k % 2 == 0, F.col("o_orderstatus") == "O"), "mode": F.when(k % 5 < 2, F.element_at(F.array(F.lit("block"), F.lit("warn")), (k % 2).cast("int") + 1)), "scope_level": F.when(k % 4 == 0, F.element_at(F.array(F.lit("org"), F.lit("team"), F.lit("repo")), (k % 3).cast("int") + 1))}
    op = F.when(F.col("o_orderpriority").startswith("1"), "create").when(F.col("o_orderpriority").startswith("2"), "delete").otherwise("update")
    return table(spark, sf_dir, "orders").select(F.concat(F.when(p < 5, F.lit(BUILT_IN)).otherwise(F.lit("own-")), p.cast("string")).alias("policy_id"), k.alias("seq"), F.col("o_orderdate").cast("date").alias("at"), op.alias("op"), *(v.alias(c) for c, v in fields.items()))


_CHANGES = """c AS (SELECT CASE WHEN o_custkey % 40 < 5 THEN 'builtin-' ELSE 'own-' END || (o_custkey % 40) AS policy_id, o_orderkey AS seq, cast(o_orderdate AS DATE) AS day, CASE left(o_orderpriority, 1) WHEN '1' THEN 'create' WHEN '2' THEN 'delete' ELSE 'update' END AS op,
CASE WHEN o_orderkey % 3 = 0 THEN 'name ' || o_orderkey END AS name, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus = 'O' END AS enabled, CASE WHEN o_orderkey % 5 < 2 THEN (['block', 'warn'])[o_orderkey % 2 + 1] END AS mode, CASE WHEN o_orderkey % 4 = 0 THEN (['org', 'team', 'repo'])[o_orderkey % 3 + 1] END AS scope_level FROM orders),
k AS (SELECT * FROM c WHERE day <= DATE '{moment}'), l AS (SELECT policy_id, max(seq) FILTER (op = 'create') AS made, max(seq) FILTER (op = 'delete' AND NOT starts_with(policy_id, 'builtin-')) AS gone FROM k GROUP BY 1 HAVING made IS NOT NULL AND (gone IS NULL OR gone < made)),
s AS (SELECT k.policy_id, count(*) AS version, max(seq) AS seq, arg_max(name, seq) FILTER (name IS NOT NULL) AS name, arg_max(enabled, seq) FILTER (enabled IS NOT NULL) AS enabled, arg_max(mode, seq) FILTER (mode IS NOT NULL) AS mode, arg_max(scope_level, seq) FILTER (scope_level IS NOT NULL) AS scope_level FROM k JOIN l ON l.policy_id = k.policy_id AND k.seq >= l.made AND k.op <> 'delete' GROUP BY 1)"""
_MOMENT = "1997-06-30"


@query("sec18_as_of", f"WITH {_CHANGES.format(moment=_MOMENT)} SELECT policy_id, version, seq, name, enabled, mode, scope_level FROM s")
def sec18_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every policy as it was at a moment, from a table that was written in parts."""
    changes, path = changes_of_orders(spark, sf_dir), shared_path(spark, "policies")
    append(changes.where("seq % 2 = 0"), path)
    append(changes.where("seq % 2 = 1"), path)
    return as_of(spark.read.parquet(path), F.lit(_MOMENT).cast("date")).drop("at")


@query("sec18_listed", f"WITH {_CHANGES.format(moment=_MOMENT)} SELECT policy_id, mode, scope_level FROM s WHERE enabled")
def sec18_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enabled policies at a moment."""
    return listed(as_of(changes_of_orders(spark, sf_dir), F.lit(_MOMENT).cast("date")), True).select("policy_id", "mode", "scope_level")
