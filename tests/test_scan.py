"""Scans by catalogs against trying every rule on every line."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.operators import catalogs, scan, syntax

RULES = catalogs.every_rule()


def brute_lines(text, rules, window=1, comments=False):
    lines = text.split("\n")
    out = []
    for at, line in enumerate(lines):
        for rule, expression, severity, cwe in rules:
            found = re.search(expression, "\n".join(lines[at : at + window]))
            if found and (comments or cwe == "CWE-798" or not line.strip().startswith(("//", "#", "*"))):
                out.append((at + 1, found.start() + 1, rule, severity, cwe))
    return sorted(out)


def test_catalogs_are_whole():
    assert len(RULES) == 346 and len(catalogs.CATALOGS) == 22 and len({r[0] for r in RULES}) == 346
    assert {r[2] for r in RULES} == {"CRITICAL", "HIGH", "MEDIUM", "LOW"}
    assert all(re.search(r[1], scan.example(r[1])) for r in RULES)
    by_name = {r[0]: r for r in RULES}
    assert by_name["azure/1"][1].endswith("[0-9a-f]{12}['\"]") and by_name["aws/6"][1] == r"(?i)aws[_-]?account[_-]?id\s*[:=]\s*['\"]?\d{12}['\"]?".replace('\\"', '"')
    assert by_name["api/9"][3] == "CWE-200" and by_name["generic/33"][2:] == ("MEDIUM", "CWE-798")


@pytest.mark.parametrize(
    ("expression", "runs"),
    [(r"(?i)AB(c|de)f", {"ab"}), (r"(abc|defg)x?", {"abc", "defg"}), (r"(abc|d*)x", {"x"}), (r"a(?:bc)d+efg", {"abc", "efg"}), (r"\bfoo\b", {"foo"}), (r"[ab]+", None), (r"(?:abc){0,2}", None), (r"x(?:abcd){2}", {"abcd"}), (r"Kıſ", {"kis"})],
)
def test_required_runs(expression, runs):
    got = scan.required(expression)
    assert (got is None) if runs is None else got <= frozenset(runs) and got


def test_required_runs_stand_in_every_match():
    for rule, expression, *_ in RULES:
        needed, text = scan.required(expression), scan.fold(scan.example(expression))
        assert needed is None or any(run in text for run in needed), rule


def texts():
    rng = random.Random(4)
    pieces = [scan.example(r[1]) for r in RULES] + ["# ", "  // ", "* ", "plain words", "paſsword='abcdef'", "toKen = 'x'", "pıckle.loads(", "a" * 60, "5H" + "z" * 50, "(a+b)+c(d+e)", "\r", "é DESé DES"]
    rows = [(i, "\n".join(rng.choice(["", "x = ", "   ", "# ", "//"]) + rng.choice(pieces) + rng.choice(["", " ", ";", "\t"]) for _ in range(rng.randrange(12)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, "\n".join(pieces)), (103, "\n".join(pieces)), (None, pieces[0])]


def test_lines_against_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "id int, text string").withColumns({"rule": F.lit("mine"), "line_number": F.lit(-1), "other": F.lit("kept")})
    got = scan.scan_lines(df)
    assert got.columns == ["id", "other", "line_number", "column", "rule", "severity", "cwe_id"]
    want = sorted(str((i, *h)) for i, t in rows if t for h in brute_lines(t, RULES))
    assert sorted(str((r.id, *r[2:])) for r in got.collect()) == want and len(want) > 500
    assert scan.scan_lines(df.limit(0)).count() == 0 and scan.scan_lines(df, ()).count() == 0


def test_rules_from_a_table_and_windows(spark):
    rules = [("b", r"x\s+y", "LOW", "CWE-1"), ("a", r"(?i)first\n.*second$", "HIGH", "CWE-2"), ("c", r"[0-9]{3}", "LOW", "CWE-3")]
    found = scan.rules_of(spark.createDataFrame(rules, "rule string, expression string, severity string, cwe_id string"))
    assert found == tuple(sorted(rules))
    rows = [(1, "no\nFIRST one\nfirst\nthe second\nlast"), (2, "x\n  y\n# 123\nx y 4567"), (3, "first\n\n\nsecond")]
    for window in (1, 2, 3):
        got = scan.scan_lines(spark.createDataFrame(rows, "id int, text string"), found, window=window, comments=True).collect()
        assert sorted(tuple(r) for r in got) == sorted((i, *h) for i, t in rows for h in brute_lines(t, found, window, True))


def test_whole_texts(spark):
    rules = [("multi", r"begin\n(.*\n)*?end", "LOW", "CWE-1"), ("word", r"\bx+\b", "LOW", "CWE-2"), ("empty", r"q*", "LOW", "CWE-3")]
    text = "begin\na\nend\nxx x\nbegin\nend q"
    got = scan.scan_texts(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), rules).where("rule <> 'empty'")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 3, "multi", "LOW", "CWE-1"), (1, 4, 4, "word", "LOW", "CWE-2"), (1, 4, 4, "word", "LOW", "CWE-2"), (1, 5, 6, "multi", "LOW", "CWE-1")]


def test_family_lines_are_family_hits(spark):
    rng = random.Random(6)
    pool = [scan.example(p) for _, p, *_ in syntax.families()] + ["plain", "password = 'secret'", "DEBUG = True  # verify=False"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(8))) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string")
    lines = df.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line_number", F.col("pos") + 1).drop("pos")
    want = sorted(tuple(r) for r in syntax.family_hits(lines).select("id", "line_number", "family", "severity", "cwe_id").collect())
    assert sorted(tuple(r) for r in syntax.family_lines(df).collect()) == want and want


def test_prefilter_cost_is_flat():
    """Six times the rules, hardly more work on lines that hold none of their runs."""
    import time

    loose = {RULES[i][0] for i in scan.Prefilter(RULES).loose}
    more = tuple((f"{r[0]}-{i}", re.sub(r"(?<![\\\[])([a-z]{4,})", rf"\1z{i}", r[1], count=1), *r[2:]) for i in range(5) for r in RULES if r[0] not in loose)
    text, took = "\n".join("some plain words of a line without anything in it" for _ in range(2000)), []
    for rules in (RULES, (*RULES, *more)):
        ready = scan.Prefilter(rules)
        began = time.perf_counter()
        for _ in range(3):
            assert not list(ready.lines(text))
        took.append(time.perf_counter() - began)
    assert took[1] < 4 * took[0]
