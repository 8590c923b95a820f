"""Detectors over source text: line patterns, entropy, Python syntax, taint flow, containers, HTTP headers, fixes, mutations."""

from __future__ import annotations

import ast
import difflib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.operators.governance import entropy
from quillon.plans.fixtures import findings
from quillon.sources.readers import numbered_lines
from quillon.sources.tables import dealt, table

#: The default catalog of line patterns: id, expression, severity, CWE. Other catalogs are passed as a table of these columns.
PATTERNS = (
    ("eval-call", r"\beval\s*\(", "HIGH", "CWE-94"), ("exec-call", r"\bexec\s*\(", "HIGH", "CWE-94"), ("shell-true", r"shell\s*=\s*True", "HIGH", "CWE-78"), ("os-system", r"os\.system\s*\(", "HIGH", "CWE-78"),
    ("sql-format", r"(?i)(select|insert|update|delete)\b.*(%s|\{\}|\+\s*\w+)", "CRITICAL", "CWE-89"), ("weak-hash", r"(?i)\b(md5|sha1)\s*\(", "MEDIUM", "CWE-327"), ("hardcoded-secret", r"(?i)(password|secret|token|api_key)\s*=\s*['\"][^'\"]{8,}['\"]", "CRITICAL", "CWE-798"),
    ("pickle-load", r"pickle\.loads?\s*\(", "HIGH", "CWE-502"), ("yaml-load", r"yaml\.load\s*\((?!.*SafeLoader)", "HIGH", "CWE-502"), ("debug-true", r"(?i)debug\s*=\s*true", "MEDIUM", "CWE-489"), ("cors-any", r"(?i)access-control-allow-origin.*\*", "MEDIUM", "CWE-942"), ("tls-off", r"verify\s*=\s*False", "HIGH", "CWE-295"),
    ("inner-html", r"\.innerHTML\s*=", "HIGH", "CWE-79"), ("tmp-path", r"['\"]/tmp/", "LOW", "CWE-377"), ("bind-all", r"0\.0\.0\.0", "LOW", "CWE-605"), ("prompt-concat", r"(?i)prompt\s*(\+=|=.*\+)\s*\w*(input|request|query)", "HIGH", "CWE-1427"), ("llm-exec", r"(?i)(exec|eval)\s*\(.*(completion|response|llm)", "CRITICAL", "CWE-94"),
)
COMMENT = r"^\s*(#|//|\*|/\*)"
#: Security headers that a response should have; words that tell a server's version.
HEADERS = ("strict-transport-security", "content-security-policy", "x-frame-options", "x-content-type-options", "referrer-policy", "permissions-policy")
DISCLOSING = ("server", "x-powered-by", "x-aspnet-version", "x-generator")
#: Calls whose results are tainted, calls that must not get tainted values (with their CWE), calls that clean.
SOURCES, CLEANERS = ("input", "get", "getenv", "argv", "read", "form"), ("escape", "quote", "int", "float", "sanitize", "clean")
SINKS = {"eval": "CWE-94", "exec": "CWE-94", "system": "CWE-78", "execute": "CWE-89", "popen": "CWE-78", "loads": "CWE-502"}
#: Rewrites that fix a line for certain.
FIXES = ((r"\bverify\s*=\s*False", "verify=True"), (r"\bhashlib\.(md5|sha1)\(", "hashlib.sha256("), (r"\byaml\.load\(", "yaml.safe_load("), (r"(?i)\bdebug\s*=\s*True", "debug=False"), (r"\beval\(", "ast.literal_eval("), (r"shell\s*=\s*True", "shell=False"))
#: Replacements of mutation testing.
MUTATIONS = (("==", "!="), ("!=", "=="), (" < ", " >= "), (" > ", " <= "), (" and ", " or "), (" or ", " and "), (" + ", " - "), (" - ", " + "), ("True", "False"), ("False", "True"), (" is ", " is not "), (" not ", " "))
# Mutation operators of Python by kind, what is replaced and by what.
MUTATION_KINDS = {
    "arithmetic": ((" + ", " - "), (" - ", " + "), (" * ", " // "), (" // ", " * ")),
    "comparison": ((" == ", " != "), (" != ", " == "), (" > ", " < "), (" < ", " > "), (" >= ", " <= "), (" <= ", " >= ")),
    "boolean": ((" and ", " or "), (" or ", " and "), ("True", "False"), ("False", "True")),
    "constant": (("return 1", "return 0"), ("return 0", "return 1"), ("return True", "return False"), ("return False", "return True"), ("return None", "return 'mutated'")),
}


def line_hits(lines: DataFrame, patterns: tuple[tuple[str, str, str, str], ...] = PATTERNS, line: str = "line") -> DataFrame:
    """A row for each line and pattern; comment lines only for secrets. One alternation sorts out most lines first."""
    at = F.col(line)
    some = lines.where(at.rlike("|".join(f"(?:{p})" for _, p, *_ in patterns)))
    each = F.array_compact(F.array(*(F.when(at.rlike(p) & (F.lit(cwe == "CWE-798") | ~at.rlike(COMMENT)), F.struct(F.lit(i).alias("rule"), F.lit(s).alias("severity"), F.lit(cwe).alias("cwe_id"))) for i, p, s, cwe in patterns)))
    return some.select("*", F.explode(each).alias("h")).select(*lines.columns, "h.*")


def high_entropy(lines: DataFrame, least: float = 4.0, line: str = "line") -> DataFrame:
    """The first quoted value of a line that has at least 20 characters and high entropy."""
    quoted = r"['\"]([A-Za-z0-9+/=_-]{20,})(?=['\"])"  # the closing quote may open the next value
    values = F.filter(F.regexp_extract_all(line, F.lit(quoted), 1), lambda v: ~F.lower(v).startswith("test"))
    good = F.filter(F.transform(values, lambda v: F.struct(v.alias("value"), entropy(v).alias("entropy"))), lambda h: h["entropy"] >= least)
    return lines.where(F.col(line).rlike(quoted)).withColumn("h", F.get(good, F.lit(0))).where("h IS NOT NULL").select(*lines.columns, "h.*")


def missing_headers(headers: Column) -> Column:
    """Security headers that a response (a map) lacks, names ignoring case."""
    have = F.transform(F.map_keys(headers), F.lower)
    return F.array_except(F.array(*map(F.lit, HEADERS)), have)


def disclosed(headers: Column) -> Column:
    return F.array_intersect(F.array(*map(F.lit, DISCLOSING)), F.transform(F.map_keys(headers), F.lower))


def dockerfile_checks(text: Column) -> Column:
    """Ids of the checks that a Dockerfile fails."""
    check = lambda name, bad: F.when(bad, name)
    return F.array_compact(F.array(check("latest-tag", text.rlike(r"(?mi)^FROM\s+[^\s:@]+(:latest)?\s*$")), check("root-user", ~text.rlike(r"(?mi)^USER\s+(?!root\b|0\b)\S+")), check("add-instead-of-copy", text.rlike(r"(?mi)^ADD\s")), check("env-secret", text.rlike(r"(?mi)^ENV\s+\S*(PASSWORD|SECRET|TOKEN|KEY)\S*[= ]")), check("no-healthcheck", ~text.rlike(r"(?mi)^HEALTHCHECK\s")), check("sudo", text.rlike(r"(?mi)^RUN\s.*\bsudo\b")), check("curl-pipe", text.rlike(r"(?mi)^RUN\s.*(curl|wget)[^|]*\|\s*(ba)?sh"))))


def kubernetes_checks(text: Column) -> Column:
    check = lambda name, p, present=True: F.when(text.rlike(p) if present else ~text.rlike(p), name)
    return F.array_compact(F.array(check("privileged", r"privileged:\s*true"), check("host-network", r"hostNetwork:\s*true"), check("host-pid", r"hostPID:\s*true"), check("escalation", r"allowPrivilegeEscalation:\s*true"), check("no-limits", r"limits:", False), check("no-non-root", r"runAsNonRoot:\s*true", False), check("wildcard-verbs", r"verbs:\s*\[\s*['\"]\*")))


def fixed_line(line: Column) -> Column:
    for p, r in FIXES:
        line = F.regexp_replace(line, p, r)
    return line


def unified_diff(df: DataFrame, before: str, after: str, path: str, to: str = "diff") -> DataFrame:
    """The change as a unified diff, in Arrow batches."""

    @F.pandas_udf("string")
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(["".join(difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), f"a/{p}", f"b/{p}")) for a, b, p in rows.itertuples(index=False)], dtype=object)

    return df.withColumn(to, run(F.struct(before, after, path)))


def mutants(lines: DataFrame, line: str = "line") -> DataFrame:
    """A row for each operator that changes a line."""
    each = F.array_compact(F.array(*(F.when(F.col(line).contains(a), F.struct(F.lit(f"{a.strip()}->{b.strip()}").alias("operator"), F.replace(line, F.lit(a), F.lit(b)).alias("mutant"))) for a, b in MUTATIONS)))
    return lines.select("*", F.explode(each).alias("m")).select(*lines.columns, "m.*")


def first_mutants(lines: DataFrame, line: str = "line") -> DataFrame:
    """mutation_type, original_code and mutated_code of every operator that applies to a line: its first occurrence there is replaced.

    Comment lines are left alone, and lines that hold an odd number of both kinds of quotes; an operator has to stand in the
    line without the white space around it.
    """
    at, bare = F.col(line), F.trim(F.translate(line, "\t\r", "  "))
    odd = lambda q: (F.length(bare) - F.length(F.replace(bare, F.lit(q), F.lit("")))) % 2 == 1
    safe = ~bare.startswith("#") & ~(odd('"') & odd("'"))

    def replaced(a: str, b: str) -> Column:
        p = F.instr(at, a)
        return F.concat(F.substring(at, F.lit(1), p - 1), F.lit(b), F.substring(at, p + len(a), F.length(at)))

    each = [F.when(bare.contains(a), F.struct(F.lit(kind).alias("mutation_type"), bare.alias("original_code"), F.trim(F.translate(replaced(a, b), "\t\r", "  ")).alias("mutated_code"))) for kind, pairs in MUTATION_KINDS.items() for a, b in pairs]
    return lines.where(safe).select("*", F.explode(F.array_compact(F.array(*each))).alias("m")).drop(line).select("*", "m.*").drop("m")


def _name(node: ast.AST) -> str:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else _name(node.func) if isinstance(node, ast.Call) else _name(node.value) if isinstance(node, (ast.Subscript, ast.Starred)) else ""


_HOLDERS = (ast.stmt, ast.excepthandler, ast.match_case)
#: Nodes without parts, and what stands in a tree beside nodes: names, numbers, marks (load, store, operators).
_LEAVES = frozenset((ast.Name, ast.Constant, str, int, bool, type(None), *(c for c in vars(ast).values() if isinstance(c, type) and issubclass(c, (ast.expr_context, ast.boolop, ast.operator, ast.unaryop, ast.cmpop)))))
_PLAIN = _LEAVES - {ast.Name, ast.Constant}
_BRANCHES = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.AsyncFor)


def walked(node: ast.AST, known: dict[ast.AST, list[ast.AST]]) -> list[ast.AST]:
    """What ast.walk gives, in its order; lists once made are kept in known."""
    if (found := known.get(node)) is None:
        found = known[node] = [node]
        for n in found:  # grows as it is read
            for name in n._fields:
                value = getattr(n, name, None)
                if isinstance(value, list):
                    found += [x for x in value if isinstance(x, ast.AST)]
                elif isinstance(value, ast.AST) and value._fields:  # marks without fields (load, store, operators) say nothing
                    found.append(value)
    return found


def parse_python(text: str) -> list[tuple[str, str, int, int, int]]:
    """kind, name, first and last line, and complexity of every function and class; nothing if the text does not parse."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError):
        return []
    out, known = [], {}
    for node in walked(tree, known):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            branches = sum(1 if isinstance(x, _BRANCHES) else len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0 for x in walked(node, known))
            out.append(("class" if isinstance(node, ast.ClassDef) else "function", node.name, node.lineno, node.end_lineno or node.lineno, 1 + branches))
    return sorted(out, key=lambda r: r[2])


def taint_flows(text: str) -> list[tuple[str, str, int, int, bool]]:
    """sink, CWE, line of the source, line of the sink and whether it was cleaned, within each function in order of its statements.

    The tree is gone through once; what an expression reads is noted when it is first asked for, and a call is judged again only
    after a name's state has changed.
    """
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError):
        return []
    parts: dict[ast.AST, list[ast.AST]] = {}  # of every node that has some
    inner: dict[ast.AST, list[ast.AST]] = {tree: []}  # a statement's statements (handlers, cases), and the one that holds it
    holder: dict[ast.AST, ast.AST | None] = {tree: None}
    scopes, calls, todo, held_by = [tree], [], [tree], [tree]
    for node, held in zip(todo, held_by):  # both grow as they are read
        own: list[ast.AST] = []
        for field in node._fields:
            value = getattr(node, field, None)
            if type(value) is list:
                own += value
            elif value is not None and type(value) not in _PLAIN:
                own.append(value)
        if not own:
            continue
        parts[node] = own
        kind = type(node)
        if kind is ast.Call and (name := _name(node)) in SINKS:
            calls.append((name, node, held))
        elif kind is ast.FunctionDef or kind is ast.AsyncFunctionDef:
            scopes.append(node)
        for x in own:
            if type(x) not in _LEAVES:
                todo.append(x)
                if isinstance(x, _HOLDERS):
                    inner[held].append(x)
                    inner[x], holder[x] = [], held
                    held_by.append(x)
                else:
                    held_by.append(held)
    sinks: dict[ast.AST, list[tuple[str, ast.Call]]] = {}  # of everything that holds a sink
    for name, call, held in calls:
        while held is not None:
            sinks.setdefault(held, []).append((name, call))
            held = holder[held]
    reads: dict[ast.AST, tuple[list[str], bool, int | None]] = {}

    def of(expr: ast.AST, tainted: dict[str, tuple[int, bool]]) -> tuple[int, bool] | None:
        if (read := reads.get(expr)) is None:
            names, cleaned, source, nodes = [], False, None, [expr]
            for n in nodes:
                if n in parts:
                    nodes += parts[n]
                if isinstance(n, ast.Name):
                    names.append(n.id)
                elif isinstance(n, (ast.Call, ast.Subscript, ast.Attribute)):
                    name = _name(n)
                    cleaned = cleaned or isinstance(n, ast.Call) and name in CLEANERS
                    source = n.lineno if source is None and name in SOURCES else source
            read = reads[expr] = names, cleaned, source
        names, cleaned, source = read
        for name in names:
            if name in tainted:
                line, clean = tainted[name]
                return line, clean or cleaned
        return None if source is None else (source, cleaned)

    out = set()
    for scope in scopes:
        if scope not in sinks:
            continue
        tainted: dict[str, tuple[int, bool]] = {}
        judged: dict[ast.Call, int] = {}
        states, inside = 0, [scope]
        for s in inside:
            inside += inner[s]
            if s is scope or not isinstance(s, ast.stmt):
                continue
            for name, call in sinks.get(s, ()):
                if judged.get(call) != states:
                    judged[call] = states
                    for arg in call.args:
                        if (got := of(arg, tainted)) is not None:
                            out.add((name, SINKS[name], got[0], call.lineno, got[1]))
            if isinstance(s, ast.Assign) and (got := of(s.value, tainted)) is not None:
                for t in s.targets:
                    if isinstance(t, ast.Name) and tainted.get(t.id) != got:
                        tainted[t.id] = got
                        states += 1
    return sorted(out)


def parsed(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row for each function and class of each Python text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *r) for k, t in zip(b[key], b[text]) for r in parse_python(t)]
            yield pd.DataFrame(rows, columns=[key, "kind", "name", "start", "stop", "complexity"])

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, kind string, name string, start int, stop int, complexity int")


def flows(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row for each flow of tainted data in each Python text."""
    types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(1)):
                found = taint_flows(t.as_py())
                at += [i] * len(found)
                rows += found
            columns = zip(*rows) if rows else [()] * len(types)
            found = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *found], names=[key, "sink", "cwe_id", "source_line", "sink_line", "cleaned"])

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, sink string, cwe_id string, source_line int, sink_line int, cleaned boolean")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python files made from the parts: path and text. What is planted in them (flows of tainted data, cleaned or not, weak
    hashes, secrets) follows from the part's key and size."""
    k, size = F.col("p_partkey"), F.col("p_size")
    either = lambda c, one, other: F.when(c, F.lit(one)).otherwise(F.lit(other))
    lines = [
        F.lit("import os"), F.lit(""), F.concat(F.lit("def run_"), k.cast("string"), F.lit("(request):")), F.lit("    name = request.get('name')"), either(size % 2 == 1, "    clean = escape(name)", "    clean = name"),
        F.lit("    os.system('ls ' + clean)"), either(size % 3 == 0, "    query = input()", "    query = 'x'"), F.lit("    cursor.execute(query)"), either(k % 4 == 0, "    return hashlib.md5(name)", "    return hashlib.sha256(name)"), F.lit(""),
        F.concat(F.lit("class Box_"), k.cast("string"), F.lit(":")), either(k % 5 == 0, "    token = 'a8f5f167f44f4964e6c998dee827110c'", "    token = None"), F.lit("    def size(self, n):"), F.lit("        return n == 1 and n > 0"),
    ]
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(F.concat(F.lit("src/p"), k.cast("string"), F.lit(".py")).alias("path"), F.concat_ws("\n", *lines).alias("text"))


_PATH = "'src/p' || p_partkey || '.py'"


def _rule_sql(rule: str, pattern: str, severity: str, cwe: str) -> str:
    """The hits of a rule as DuckDB text; a lookahead for what must not follow is a test of what stands after the last match."""
    head, _, tail = pattern.replace("'", "''").partition("(?!.*")
    hit = f"regexp_matches(line, '{head}')" + (f" AND NOT contains(regexp_extract(line, '.*{head}(.*)', 1), '{tail[:-1]}')" if tail else "")
    return f"SELECT doc_id, line_number, '{rule}' AS rule, '{severity}' AS severity, '{cwe}' AS cwe_id FROM lines WHERE {hit}" + ("" if cwe == "CWE-798" else f" AND NOT regexp_matches(line, '{COMMENT}')")


@query("txt05_line_patterns_all", "WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, cast(generate_subscripts(string_split(text, chr(10)), 1) as int) AS line_number FROM documents) " + " UNION ALL ".join(_rule_sql(*p) for p in PATTERNS))
def txt05_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = line_hits(numbered_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return hits.select("doc_id", "line_number", "rule", "severity", "cwe_id")


@query("txt05_source_scan", f"SELECT {_PATH} AS path, 6 AS line_number, 'os-system' AS rule, 'HIGH' AS severity, 'CWE-78' AS cwe_id FROM part UNION ALL SELECT {_PATH}, 9, 'weak-hash', 'MEDIUM', 'CWE-327' FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT {_PATH}, 12, 'hardcoded-secret', 'CRITICAL', 'CWE-798' FROM part WHERE p_partkey % 5 = 0")
def txt05_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_hits(numbered_lines(sources(spark, sf_dir)).drop("text")).select("path", "line_number", "rule", "severity", "cwe_id")


@query("txt06_entropy")
def txt06(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = sources(spark, sf_dir).unionByName(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"))
    return high_entropy(numbered_lines(texts).drop("text"), 3.0).select("path", "line_number", F.bround("entropy", 4).alias("entropy"))


_FLOWS = f"SELECT {_PATH} AS path, 'system' AS sink, 'CWE-78' AS cwe_id, 4 AS source_line, 6 AS sink_line, p_size % 2 = 1 AS cleaned FROM part UNION ALL SELECT {_PATH}, 'execute', 'CWE-89', 7, 8, false FROM part WHERE p_size % 3 = 0"


@query("txt10_taint", _FLOWS)
def txt10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(sources(spark, sf_dir), "path")


@query("agg42_taint_summary", f"SELECT cwe_id, count(*) AS n, count(*) FILTER (cleaned) AS cleaned FROM ({_FLOWS}) GROUP BY 1")
def agg42(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(sources(spark, sf_dir), "path").groupBy("cwe_id").agg(F.count("*").alias("n"), F.count_if("cleaned").alias("cleaned"))


@query("txt14_parsed", f"SELECT {_PATH} AS path, 'function' AS kind, 'run_' || p_partkey AS name, 3 AS start, 9 AS stop, 1 AS complexity FROM part UNION ALL SELECT {_PATH}, 'class', 'Box_' || p_partkey, 11, 14, 2 FROM part UNION ALL SELECT {_PATH}, 'function', 'size', 13, 14, 2 FROM part")
def txt14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(sources(spark, sf_dir), "path")


@query("txt15_fixes", "SELECT item_id, regexp_replace(regexp_replace(text, '\\bverify\\s*=\\s*False', 'verify=True', 'g'), 'shell\\s*=\\s*True', 'shell=False', 'g') AS fixed FROM (SELECT item_id, text || ' verify = False shell=True' AS text FROM benchmark)")
def txt15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", fixed_line(F.concat("text", F.lit(" verify = False shell=True"))).alias("fixed"))


@query("txt16_mutants", f"SELECT {_PATH} AS path, m.* FROM part, (VALUES (6, '+->-', '    os.system(''ls '' - clean)'), (14, '==->!=', '        return n != 1 and n > 0'), (14, 'and->or', '        return n == 1 or n > 0'), (14, '>-><=', '        return n == 1 and n <= 0')) m(line_number, operator, mutant)")
def txt16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutants(numbered_lines(sources(spark, sf_dir)).drop("text")).select("path", "line_number", "operator", "mutant")


def _first_mutants_sql() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    bare = lambda x: f"trim(translate({x}, chr(9) || chr(13), '  '))"
    quotes = lambda c: f"(length(line) - length(replace(line, chr({c}), ''))) % 2"
    rows = []
    for kind, pairs in MUTATION_KINDS.items():
        for a, b in pairs:
            mutated = f"line[:strpos(line, {q(a)}) - 1] || {q(b)} || line[strpos(line, {q(a)}) + {len(a)}:]"
            rows.append(f"SELECT doc_id, line_number, '{kind}' AS mutation_type, bare AS original_code, {bare(mutated)} AS mutated_code FROM lines WHERE contains(bare, {q(a)})")
    every = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, cast(generate_subscripts(string_split(text, chr(10)), 1) as int) AS line_number FROM documents"
    return f"WITH every AS ({every}), lines AS (SELECT *, {bare('line')} AS bare FROM every WHERE NOT starts_with({bare('line')}, '#') AND {quotes(34)} + {quotes(39)} < 2) " + " UNION ALL ".join(rows)


@query("txt16_first_mutants", _first_mutants_sql())
def txt16_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mutation operators over the lines of the documents."""
    return first_mutants(numbered_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))


@query("txt11_dockerfiles", "SELECT p_brand AS path, list_contains(list(p_size % 2 = 0), true) AS latest FROM part GROUP BY 1")
def txt11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dockerfiles made from the parts: an even size pins no tag."""
    files = table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.when(F.col("p_size") % 2 == 0, F.lit("FROM python\nUSER app\nHEALTHCHECK CMD true\n")).otherwise(F.lit("FROM python:3.12\nUSER app\nHEALTHCHECK CMD true\n")).alias("text"))
    checked = files.select("path", dockerfile_checks(F.col("text")).alias("failed"))
    return checked.groupBy("path").agg(F.bool_or(F.array_contains("failed", "latest-tag")).alias("latest"))


@query("txt12_headers", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 4 ELSE 5 END AS missing FROM events")
def txt12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response headers made from the events."""
    one = F.create_map(F.lit("Strict-Transport-Security"), F.lit("max-age=1"), F.lit("Server"), F.lit("x"))
    two = F.map_concat(one, F.create_map(F.lit("X-Frame-Options"), F.lit("DENY")))
    return table(spark, sf_dir, "events").select("event_id", F.size(missing_headers(F.when(F.col("user_id") % 3 == 0, two).otherwise(one))).alias("missing"))


_CONTAINERS = {
    "latest-tag": ("p_size % 2 = 0", "FROM python:latest", "FROM python:3.12"), "root-user": ("p_size % 3 = 0", "USER root", "USER app"), "add-instead-of-copy": ("p_size % 5 = 0", "ADD . /app", "COPY . /app"), "env-secret": ("p_partkey % 3 = 0", "ENV DB_PASSWORD=x", "ENV MODE=x"),
    "no-healthcheck": ("p_partkey % 5 = 0", "# HEALTHCHECK CMD true", "HEALTHCHECK CMD true"), "sudo": ("p_partkey % 7 = 0", "RUN apt update && sudo make", "RUN make # pseudo"), "curl-pipe": ("p_size % 7 = 0", "RUN curl -s http://x | bash", "RUN curl -s http://x -o y"),
}
_PODS = {
    "privileged": ("p_size % 2 = 0", "privileged: true", "privileged: false"), "host-network": ("p_size % 3 = 0", "hostNetwork: true", "hostNetwork: false"), "host-pid": ("p_size % 5 = 0", "hostPID: true", "kind: Pod"), "escalation": ("p_partkey % 3 = 0", "allowPrivilegeEscalation: true", "allowPrivilegeEscalation: false"),
    "no-limits": ("p_partkey % 5 = 0", "requests:", "limits:"), "no-non-root": ("p_partkey % 7 = 0", "runAsNonRoot: false", "runAsNonRoot: true"), "wildcard-verbs": ("p_size % 7 = 0", "verbs: ['*']", "verbs: ['get']"),
}


def _failed_sql(planted: dict[str, tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT p_partkey, '{name}' AS failed FROM part WHERE {bad}" for name, (bad, _, _) in planted.items())


def _planted(part: DataFrame, planted: dict[str, tuple[str, str, str]]) -> DataFrame:
    return part.select("p_partkey", F.concat_ws("\n", *(F.when(F.expr(bad), F.lit(one)).otherwise(F.lit(other)) for bad, one, other in planted.values())).alias("text"))


@query("txt11_docker_checks", _failed_sql(_CONTAINERS))
def txt11_docker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks over Dockerfiles made from the parts, in which each fault is planted apart from the others."""
    return _planted(table(spark, sf_dir, "part"), _CONTAINERS).select("p_partkey", F.explode(dockerfile_checks(F.col("text"))).alias("failed"))


@query("txt11_kubernetes_checks", _failed_sql(_PODS))
def txt11_kubernetes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planted(table(spark, sf_dir, "part"), _PODS).select("p_partkey", F.explode(kubernetes_checks(F.col("text"))).alias("failed"))


_SENT = {h: f"p_partkey % {n} = 0" for h, n in zip((*HEADERS, *DISCLOSING), (2, 3, 5, 7, 11, 13, 2, 3, 5, 7))}


@query("txt12_header_checks", " UNION ALL ".join([f"SELECT p_partkey, '{h}' AS header, 'missing' AS fault FROM part WHERE NOT {_SENT[h]}" for h in HEADERS] + [f"SELECT p_partkey, '{h}', 'disclosing' FROM part WHERE {_SENT[h]}" for h in DISCLOSING]))
def txt12_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and disclosing headers by name, of responses made from the parts; names come in different cases."""
    entries = F.array_compact(F.array(*(F.when(F.expr(sent), F.struct((F.upper(F.lit(h)) if i % 2 else F.initcap(F.lit(h))).alias("k"), F.lit("x").alias("v"))) for i, (h, sent) in enumerate(_SENT.items()))))
    made = table(spark, sf_dir, "part").select("p_partkey", F.map_from_entries(entries).alias("m"))
    faults = F.concat(F.transform(missing_headers(F.col("m")), lambda h: F.struct(h.alias("header"), F.lit("missing").alias("fault"))), F.transform(disclosed(F.col("m")), lambda h: F.struct(h.alias("header"), F.lit("disclosing").alias("fault"))))
    return made.select("p_partkey", F.explode(faults).alias("f")).select("p_partkey", "f.*")
