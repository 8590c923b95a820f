"""Parsers of tool outputs, lock files, archives, logs and policy files."""

from __future__ import annotations

import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon import catalog
from quillon.functions import scalars
from quillon.operators import detectors, policy
from quillon.sources import tools


def one(spark, parse, document):
    return [tuple(r) for r in parse(spark.createDataFrame([(json.dumps(document),), ("{broken",)], "json string")).collect()]


def test_tool_outputs(spark):
    assert one(spark, tools.bandit, {"results": [{"test_id": "B1", "filename": "a.py", "line_number": 2, "issue_severity": "MEDIUM", "issue_text": "t", "issue_cwe": {"id": 78}}]}) == [("bandit", "B1", "a.py", 2, "MEDIUM", "t", "CWE-78")]
    assert one(spark, tools.eslint, [{"filePath": "a.js", "messages": [{"ruleId": "r", "severity": 2, "message": "m", "line": 1}]}])[0][4] == "HIGH"
    assert one(spark, tools.pylint, [{"type": "fatal", "symbol": "s", "path": "p", "line": 1, "message": "m"}])[0][4] == "CRITICAL"
    assert one(spark, tools.pmd, {"files": [{"filename": "A.java", "violations": [{"beginline": 1, "rule": "r", "priority": 3, "description": "d"}]}]})[0][4] == "MEDIUM"
    assert one(spark, tools.gitleaks, [{"RuleID": "r", "File": "f", "StartLine": 1, "Secret": "1234567890"}])[0][5] == "123****890"
    assert one(spark, tools.dependency_check, {"dependencies": [{"fileName": "x.jar", "vulnerabilities": [{"name": "CVE-1", "description": "d", "cvssv3": {"baseScore": 9.8}, "cwes": ["CWE-1"]}]}]})[0][4] == "CRITICAL"


@pytest.mark.parametrize(("name", "text", "want"), [
    ("package-lock.json", '{"packages": {"": {"version": "1"}, "node_modules/Left-Pad": {"version": "1.3.0"}}}', [("left-pad", "1.3.0")]),
    ("composer.lock", '{"packages": [{"name": "A/b", "version": "2"}]}', [("a/b", "2")]), ("Pipfile.lock", '{"default": {"Flask": {"version": "==2.0"}}}', [("flask", "2.0")]),
    ("poetry.lock", '[[package]]\nname = "x"\nversion = "1.0"\n', [("x", "1.0")]), ("go.mod", "module m\nrequire github.com/a/b v1.2.3\n", [("github.com/a/b", "1.2.3")]),
    ("pom.xml", "<dependency><artifactId>core</artifactId>\n<version>5</version></dependency>", [("core", "5")]), ("build.gradle", "implementation 'g.h:art:1.0'", [("g.h:art", "1.0")]), ("other", "x==1", None),
])
def test_lock_files(spark, name, text, want):
    got = spark.createDataFrame([(name, text)], "n string, t string").select(tools.lock_file(F.col("n"), F.col("t")).alias("d")).first().d
    assert (got if got is None else [tuple(x) for x in got]) == want


def test_archives_keep_inside(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("src/a.py", "x")
        z.writestr("../evil.py", "y")
    assert [(r.path, bytes(r.content)) for r in tools.unzipped(spark, str(tmp_path)).collect()] == [("src/a.py", b"x")]


def test_daily_log(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, TIMESTAMP '2024-01-01 10:00:00' AS ts UNION ALL SELECT 2, TIMESTAMP '2024-01-02 10:00:00'")
    tools.append_daily(df, str(tmp_path / "log"))
    assert [r.a for r in tools.daily_log(spark, str(tmp_path / "log"), "a int, ts timestamp", "2024-01-02").collect()] == [2]


def test_policy_file(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"name": "p", "rules": [{"id": "r", "conditions": [{"type": "severity_count", "value": "HIGH", "count": 3}]}]}))
    assert tuple(tools.policy_file(spark, str(tmp_path / "p.json")).first()) == ("p", "r", "ERROR", "severity_count", "HIGH", 3)


def test_phases_and_maturity(spark):
    v = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert v(policy.phased(F.lit("PHASED"), F.lit(1), F.lit(2))) == "WARN" and v(policy.phased(F.lit("PHASED"), F.lit(3), F.lit(2))) == "ERROR"
    assert v(policy.maturity(F.lit(79.9), F.lit(2), F.lit(10))) == 79 and v(policy.maturity(F.lit(79.9), F.lit(2), F.lit(10), strict=True)) == 74
    assert [v(policy.shifted_confidence(F.lit(x), d)) for x, d in (("LOW", -1), ("MEDIUM", 1), ("odd", 0))] == ["LOW", "HIGH", "MEDIUM"]


def test_detectors(spark):
    v = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert v(detectors.dockerfile_checks(F.lit("FROM python\nADD x y\n"))) == ["latest-tag", "root-user", "add-instead-of-copy", "no-healthcheck"]
    assert "privileged" in v(detectors.kubernetes_checks(F.lit("privileged: true\nlimits:\nrunAsNonRoot: true")))
    assert v(detectors.fixed_line(F.lit("requests.get(u, verify=False)"))) == "requests.get(u, verify=True)"
    lines = spark.createDataFrame([("os.system('x')",), ("# eval(x)",), ("# password = 'abcdefgh1'",)], "line string")
    assert sorted(r.rule for r in detectors.line_hits(lines).collect()) == ["hardcoded-secret", "os-system"]
    assert detectors.taint_flows("def f():\n  a = input()\n  b = int(a)\n  eval(a)\n  eval(b)\n") == [("eval", "CWE-94", 2, 4, False), ("eval", "CWE-94", 2, 5, True)]
    assert detectors.taint_flows("def (") == [] and detectors.parse_python("def f(a):\n  return 1 if a and a else 2\n") == [("function", "f", 1, 2, 3)]
    diff = detectors.unified_diff(spark.createDataFrame([("a\n", "b\n", "f")], "x string, y string, p string"), "x", "y", "p").first().diff
    assert diff.splitlines()[-2:] == ["-a", "+b"]


def test_all_rules_and_documents(spark, sf_dir, tmp_path):
    planted = [(-1, "eval(x)\n# eval(x)\nrequests.get(u, verify=False)", "fr"), (-2, "yaml.load(f)\nyaml.load(f, SafeLoader)\n# token = 'abcdefgh1'", None), (-3, None, "en")]
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").unionByName(spark.createDataFrame(planted, "doc_id long, text string, lang string"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    want = set()
    for r in df.collect():
        for number, line in enumerate((r.text or "").split("\n"), 1):
            want |= {(r.doc_id, number, rule) for rule, p, _, cwe in detectors.PATTERNS if re.search(p, line) and (cwe == "CWE-798" or not re.match(detectors.COMMENT, line))}
    got = [(r.doc_id, r.line_number, r.rule) for r in detectors.txt05_all(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want and {"eval-call", "tls-off", "yaml-load", "hardcoded-secret"} <= {r for _, _, r in want}
    duckdb = pytest.importorskip("duckdb").connect()
    duckdb.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {r[:3] for r in duckdb.execute(catalog.oracle_sql()["txt05_line_patterns_all"]).fetchall()} == want
    assert scalars.scl38_all(spark, str(tmp_path)).count() == df.count()


def test_entropy_tries_all_values_of_a_line(spark):
    secret = "a8F5f167f44f4964E6c998dee827110c"
    lines = [f"x = '{'ab' * 12}', 'test{secret}', '{secret}', '{secret[::-1]}'", f"'{secret}'", f"'test{secret}'", f"'{'a' * 30}'", "none", None]
    got = detectors.high_entropy(spark.createDataFrame(list(enumerate(lines)), "line_number int, line string"), 3.0).collect()
    assert sorted((r.line_number, r.value) for r in got) == [(0, secret), (1, secret)]
