"""Files made from a small table are many tasks, and what is read of each costs little."""

from __future__ import annotations

import ast

from quillon.operators import detectors, syntax
from quillon.operators.scan import required
from quillon.sources.readers import numbered_lines


def test_sources_are_dealt_over_the_tasks_of_a_shuffle(spark, sf_dir):
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    for made in (detectors.sources(spark, sf_dir), syntax.code_files(spark, sf_dir)):
        assert made.rdd.getNumPartitions() == wanted


def test_walks_are_those_of_ast_but_for_marks_and_are_kept():
    tree, known = ast.parse("def f(a, *b):\n    x = [i for i in a if i]\n    return g(x)[1:2] + b\nclass C(D):\n    pass"), {}
    for node in ast.walk(tree):
        assert [n for n in detectors.walked(node, known) if n._fields] == [n for n in ast.walk(node) if n._fields]
    assert detectors.walked(tree, known) is detectors.walked(tree, known)


def test_families_are_found_in_any_case_of_letters(spark):
    lines = ["DEBUG = TRUE", "r = get(url, VERIFY=false)", "x = 1", "requests.send_request(u)", "REQUESTS.send_request(u)", "", None]
    df = spark.createDataFrame([(n, x) for n, x in enumerate(lines)], "n int, text string")
    got = {(r.n, r.family) for r in syntax.family_hits(numbered_lines(df).drop("text")).collect()}
    assert {(0, "Insecure default"), (1, "Insecure default"), (3, "Hallucinated API")} <= got and not {n for n, _ in got} & {2, 4, 5, 6}
    assert all(required(p) for _, p, _, _ in syntax.families())
