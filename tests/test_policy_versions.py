"""Policy tables against a dictionary that the same changes are applied to."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from quillon.sources import policy_versions as pv

SCHEMA = "policy_id string, seq long, at date, op string, name string, enabled boolean, mode string, scope_level string"
DAY = datetime.date(2024, 1, 1)


def some_changes():
    rng = random.Random(8)
    out = []
    for seq in range(400):
        pick = lambda *values: rng.choice([None, *values])  # noqa: E731, B023
        out.append((rng.choice(["a", "b", "c", "builtin-x"]), seq, DAY + datetime.timedelta(days=seq // 4), rng.choice(["create", "update", "update", "update", "delete"]), pick("n", "m"), pick(True, False), pick("block", "warn"), pick("org", "team")))
    return out


def replayed(changes, moment):
    state = {}
    for policy, seq, at, op, *fields in changes:
        if at > moment:
            continue
        if op == "create":
            state[policy] = (1, seq, *fields)
        elif op == "update" and policy in state:
            version, _, *old = state[policy]
            state[policy] = (version + 1, seq, *(o if f is None else f for f, o in zip(fields, old)))
        elif op == "delete" and not policy.startswith("builtin-"):
            state.pop(policy, None)
    return {(k, *v) for k, v in state.items()}


def test_as_of_is_the_replay(spark, tmp_path):
    changes = some_changes()
    df = spark.createDataFrame(random.Random(1).sample(changes, len(changes)), SCHEMA)
    path, small = f"{tmp_path}/changes", f"{tmp_path}/compact"
    pv.append(df.where("seq < 200"), path)
    pv.append(df.where("seq >= 200"), path)
    table = spark.read.parquet(path)
    state = lambda d, day: {(r.policy_id, r.version, r.seq, r.name, r.enabled, r.mode, r.scope_level) for r in pv.as_of(d, F.lit(day)).collect()}
    days = [DAY - datetime.timedelta(days=1), DAY, DAY + datetime.timedelta(days=33), DAY + datetime.timedelta(days=70), DAY + datetime.timedelta(days=99)]
    for day in days:
        assert state(table, day) == replayed(changes, day)
    pv.compact(path, small, F.lit(days[2]), spark)
    for day in days[2:]:  # versions begin anew with the compaction
        drop = lambda rows: {(r[0], *r[2:]) for r in rows}
        assert drop(state(spark.read.parquet(small), day)) == drop(replayed(changes, day))
    assert spark.read.parquet(small).count() < len(changes)


def test_listing(spark):
    rows = [("a", 1, DAY, "create", "n", True, "block", "team"), ("b", 2, DAY, "create", "n", False, "block", "team"), ("c", 3, DAY, "create", "n", True, "warn", "org"), (None, 4, DAY, "create", "n", True, "warn", "org")]
    policies = pv.as_of(spark.createDataFrame(rows, SCHEMA))
    ids = lambda d: sorted(r.policy_id for r in d.collect())
    assert ids(pv.listed(policies)) == ["a", "b", "c"] and ids(pv.listed(policies, True)) == ["a", "c"] and ids(pv.listed(policies, True, "team")) == ["a"]
    assert pv.as_of(spark.createDataFrame([], SCHEMA)).count() == 0
