"""Checks of files deal them by key once, over as many tasks as a shuffle has, and everything is made where a file then lies."""

from __future__ import annotations

import contextlib
import io

import pytest

from quillon.operators import blocks, extents


@pytest.mark.parametrize("check", [extents.extents, blocks.terraform_findings])
def test_files_are_shuffled_once_and_not_joined_to_fewer_tasks(spark, check):
    df = spark.createDataFrame([("a.js", "function f() {\n}"), ("a.js", "function f() {\n}"), ("b.tf", 'resource "aws_ebs_volume" "v" {\n}')], "path string, text string")
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        check(df).explain()
    assert said.getvalue().count("Exchange") == 1 and "REPARTITION_BY_NUM" in said.getvalue()
    assert check(df).count() == 1


def test_files_of_queries_are_dealt(spark, sf_dir):
    for made in (extents.planted(spark, sf_dir), blocks._files(spark, sf_dir, ["a"], ".tf")):
        assert made.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
