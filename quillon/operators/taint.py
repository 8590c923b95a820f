"""Taint flows as tables: definitions and uses are facts, what is tainted is a fixpoint of joins.

A text's facts are nodes: a definition (a variable assigned in a statement, a parameter, a loop's variable) or a sink (an
argument of a dangerous call), each with the definitions that reach it. Reading facts from one text is a small helper in
Arrow batches; everything across statements is Spark's: an edge for each definition that reaches a node, and a semi-naive
closure from the sources in which each round joins only what the round before has found, until nothing is new. A node is
tainted from the source fewest steps away (the first line of equals), for each kind of sink apart, because a cleaner kills
taint for some kinds only.

Two ways to read facts. ``ordered`` takes a scope's statements one after the other, whatever branch or loop they are in: a
definition reaches all later statements, and a variable once tainted stays so. ``flow`` follows the control flow: a new
assignment ends the earlier ones of its variable, branches are joined, loops are read until nothing changes, and an
assignment whose statement holds a cleaner kills the taint of the kinds that it cleans.

Cases: texts that are null, empty or do not parse have no facts; parameters other than self and cls are sources; equal rows
count once; an empty table gives no rows; other columns of the table are not read.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.sources.shared import shared_path
from quillon.sources.tables import table

# What stands in a line that yields foreign data.
SOURCES = (
    r"request\.args\[", r"request\.form\[", r"request\.json", r"request\.data", r"request\.files", r"request\.values", r"request\.cookies", r"request\.headers\[", r"request\.get_json", r"request\.get_data", r"flask\.request\.",
    r"req\.query", r"req\.params", r"req\.body", r"req\.headers", r"req\.[a-z_]+",
    r"request\.GET\.", r"request\.POST\.", r"request\.FILES", r"request\.COOKIES", r"request\.META",
    r"sys\.argv", r"input\s*\(", r"raw_input\s*\(", r"os\.environ", r"os\.environ\.get",
    r"open\s*\(",
    r"\.recv\s*\(", r"socket\.recv", r"\.read\s*\(",
    r"request\.", r"params\[", r"args\[", r"kwargs",
)
# Calls that must not get foreign data, by kind, with severity and CWE; a call's name and a bracket are tried.
SINKS = {
    "sql_injection": ("HIGH", "CWE-89", (r"\.execute\s*\(", r"\.executemany\s*\(", r"\.raw\s*\(", r"cursor\.execute", r"Cursor\.execute", r"db\.execute", r"\.query\s*\(", r"\.run\s*\(", r"\.find\s*\(", r"\.find_one\s*\(", r"\.aggregate\s*\(")),
    "command_injection": ("CRITICAL", "CWE-78", (r"os\.system\s*\(", r"os\.popen\s*\(", r"subprocess\.call\s*\(", r"subprocess\.run\s*\(", r"subprocess\.Popen\s*\(", r"subprocess\.check_output\s*\(", r"subprocess\.check_call\s*\(", r"commands\.getoutput\s*\(", r"commands\.getstatusoutput\s*\(", r"eval\s*\(", r"exec\s*\(", r"execfile\s*\(", r"compile\s*\(", r"__import__\s*\(")),
    "xss": ("HIGH", "CWE-79", (r"render_template_string\s*\(", r"render_template\s*\(", r"\.render\s*\(", r"make_response\s*\(", r"HttpResponse\s*\(", r"\.write\s*\(", r"send_file\s*\(", r"render_to_response\s*\(", r"render_to_string\s*\(")),
    "path_traversal": ("HIGH", "CWE-22", (r"open\s*\(", r"file\s*\(", r"\.read\s*\(", r"\.write\s*\(", r"os\.open\s*\(", r"os\.read\s*\(", r"os\.write\s*\(", r"shutil\.copy\s*\(", r"shutil\.move\s*\(", r"shutil\.copyfile\s*\(", r"shutil\.copytree\s*\(", r"send_file\s*\(", r"send_from_directory\s*\(", r"\.save\s*\(")),
    "ssrf": ("HIGH", "CWE-918", (r"urllib\.request\.urlopen\s*\(", r"urllib2\.urlopen\s*\(", r"requests\.get\s*\(", r"requests\.post\s*\(", r"requests\.put\s*\(", r"requests\.delete\s*\(", r"requests\.head\s*\(", r"requests\.patch\s*\(", r"requests\.request\s*\(", r"httpx\.get\s*\(", r"httpx\.post\s*\(", r"httpx\.request\s*\(", r"http\.client\.HTTPConnection\s*\(", r"http\.client\.HTTPSConnection\s*\(", r"\.get\s*\(", r"\.post\s*\(", r"urlopen\s*\(")),
    "ldap_injection": ("HIGH", "CWE-90", (r"\.search_s\s*\(", r"\.search_ext\s*\(", r"\.search_st\s*\(")),
    "xpath_injection": ("MEDIUM", "CWE-91", (r"\.xpath\s*\(", r"\.findall\s*\(", r"\.find\s*\(", r"\.findtext\s*\(", r"\.iterfind\s*\(")),
    "xml_injection": ("MEDIUM", "CWE-91", (r"\.parse\s*\(", r"\.parseString\s*\(", r"\.fromstring\s*\(", r"ET\.parse\s*\(", r"ElementTree\.parse\s*\(", r"\.tostring\s*\(", r"\.xml\s*\(")),
    "code_injection": ("CRITICAL", "CWE-94", (r"eval\s*\(", r"exec\s*\(", r"execfile\s*\(", r"compile\s*\(", r"__import__\s*\(", r"types\.FunctionType\s*\(", r"getattr\s*\(", r"setattr\s*\(", r"hasattr\s*\(")),
}
# What cleans, by kind; the last list cleans for all kinds.
CLEANERS = {
    "sql": (r"parameteriz", r"placeholder", r"\?", r"%s", r"bindparam", r"text\s*\("),
    "xss": (r"escape\s*\(", r"bleach\.", r"htmlspecialchars", r"sanitize", r"purif", r"clean\s*\(", r"Markup\s*\(", r"strip_tags"),
    "command": (r"shlex\.quote", r"shlex\.split", r"escape\s*\(", r"validat", r"sanitize", r"re\.match", r"re\.search", r"re\.fullmatch", r"allowlist", r"whitelist", r"safepath"),
    "path": (r"os\.path\.abspath", r"os\.path\.realpath", r"os\.path\.normpath", r"secure_filename", r"pathlib\.", r"allowlist", r"whitelist", r"is_safe_path"),
    "ssrf": (r"allowlist", r"whitelist", r"urlparse", r"validators\.url", r"re\.match", r"is_safe_url", r"url_has_allowed_host"),
    "general": (r"validat", r"sanitize", r"escape", r"clean", r"int\s*\(", r"float\s*\(", r"str\s*\(", r"bool\s*\(", r"len\s*\("),
}
#: The cleaners of a kind of sink.
CLEANED_BY = {"sql_injection": "sql", "command_injection": "command", "code_injection": "command", "xss": "xss", "path_traversal": "path", "ssrf": "ssrf"}
#: A query is clean if it holds places for values and is not put together from strings.
PLACES, JOINED = r"%s|%d|\?|:\w+|%\(\w+\)s", r"['\"]\s*%\s+\w|\.format\s*\(|\+|f\"|f'"
_any = lambda patterns, flags=0: re.compile("|".join(f"(?:{p})" for p in patterns), flags)
_SOURCE = _any(SOURCES)
_SINK = {k: _any(p) for k, (_, _, p) in SINKS.items()}
_CLEAN = {k: _any(CLEANERS[CLEANED_BY[k]] if k in CLEANED_BY else (), re.I) for k in SINKS}
_GENERAL, _NAMED = _any(CLEANERS["general"], re.I), _any((r"parameteriz", r"bindparam", r"text\s*\("), re.I)
_COMPOUND = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.With, ast.AsyncWith, ast.Try, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def cleans(kind: str, statement: str) -> bool:
    """Whether a statement's text holds a cleaner for a kind of sink."""
    if kind == "sql_injection":
        return bool((re.search(PLACES, statement) or _NAMED.search(statement)) and not re.search(JOINED, statement)) or bool(_GENERAL.search(statement))
    return bool(_GENERAL.search(statement)) or kind in CLEANED_BY and bool(_CLEAN[kind].search(statement))


def dotted(node: ast.AST) -> str:
    """a.b.c of a name or a chain of attributes; what the chain hangs on is left out if it is no name."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


class Facts:
    """The nodes of a text: number -> [scope, kind, name, line, source line or 0, sink or None, cleaned, kinds killed, definitions that reach it]."""

    def __init__(self, text: str, flow: bool) -> None:
        self.lines, self.flow, self.nodes, self.numbers = text.split("\n"), flow, [], {}
        tree = ast.parse(text)
        self.read(tree.body, {}, "<module>")
        for n in ast.walk(tree):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a, env = n.args, {}
                for p in (*a.posonlyargs, *a.args, *a.kwonlyargs, *(x for x in (a.vararg, a.kwarg) if x)):
                    if p.arg not in ("self", "cls"):
                        env[p.arg] = {self.node((p,), n.name, "definition", p.arg, n.lineno, n.lineno)}
                self.read(n.body, env, n.name)

    def node(self, key: tuple, scope: str, kind: str, name: str, line: int, source: int = 0, sink: str | None = None, cleaned: bool = False, killed: tuple = (), reached: set = frozenset()) -> int:
        """The number of a node; what is read again (in a loop) is the same node, reached by more."""
        at = self.numbers.setdefault(key, len(self.nodes))
        if at == len(self.nodes):
            self.nodes.append([scope, kind, name, line, source, sink, cleaned, list(killed), set()])
        self.nodes[at][-1] |= reached
        return at

    def words(self, stmt: ast.stmt) -> str:
        return "\n".join(self.lines[stmt.lineno - 1 : stmt.end_lineno])

    def foreign(self, value: ast.expr) -> bool:
        if _SOURCE.search(self.lines[value.lineno - 1]):
            return True
        match value:
            case ast.Attribute():
                return "request" in dotted(value).lower()
            case ast.Call(func=ast.Name() | ast.Attribute()):
                return bool(_SOURCE.search(dotted(value.func)))
            case ast.Subscript():
                base = value.value
                while isinstance(base, ast.Attribute):
                    base = base.value
                return isinstance(base, ast.Name) and "request" in base.id.lower()
        return False

    def used(self, value: ast.AST, env: dict[str, set[int]]) -> set[int]:
        return set().union(*(env.get(n.id, ()) for n in ast.walk(value) if isinstance(n, ast.Name)))

    def define(self, stmt: ast.stmt, target: ast.expr, value: ast.expr, env: dict[str, set[int]], scope: str, carried: bool = True) -> None:
        name = next((n.id for n in (target.elts if isinstance(target, ast.Tuple) else [target]) if isinstance(n, ast.Name)), None)
        if name is None:
            return
        source = value.lineno if self.foreign(value) else 0
        reached = self.used(value, env) if carried else set()
        now = set()
        if source or reached:
            killed = tuple(k for k in SINKS if cleans(k, self.words(stmt))) if self.flow and not isinstance(stmt, _COMPOUND) else ()
            now = {self.node((stmt, target), scope, "definition", name, stmt.lineno, source, killed=killed, reached=reached)}
        env[name] = now if self.flow else env.get(name, set()) | now

    def sinks(self, stmt: ast.stmt, parts: list[ast.AST], env: dict[str, set[int]], scope: str) -> None:
        for call in (n for part in parts for n in ast.walk(part) if isinstance(n, ast.Call)):
            name = dotted(call.func)
            for kind in (k for k, p in _SINK.items() if name and p.search(f"{name}(")):
                for arg, value in [*((None, x) for x in call.args), *((k.arg, k.value) for k in call.keywords)]:
                    reached = self.used(value, env)
                    if reached:
                        self.node((stmt, value, kind), scope, "sink", name if arg is None else f"{name}({arg}=...)", call.lineno, 0, kind, cleans(kind, self.words(stmt)), (), reached)

    def read(self, body: list[ast.stmt], env: dict[str, set[int]], scope: str) -> dict[str, set[int]]:
        """The definitions that reach the end of a body."""
        for stmt in body:
            head = [stmt]
            if self.flow:  # a compound statement's own expressions; what it holds is read by itself
                head = [c for c in ast.iter_child_nodes(stmt) if not isinstance(c, (ast.stmt, ast.ExceptHandler))] if isinstance(stmt, _COMPOUND) else [stmt]
                self.sinks(stmt, head, env, scope)  # before its own assignment counts
            match stmt:
                case ast.Assign(targets=targets, value=value):
                    before = dict(env)
                    for t in targets:
                        after = dict(before)
                        self.define(stmt, t, value, after, scope)
                        env.update({n: d for n, d in after.items() if before.get(n) is not d})
                case ast.AnnAssign(target=target, value=value) if value:
                    self.define(stmt, target, value, env, scope)
                case ast.AugAssign(target=ast.Name(id=name), value=value) if self.flow:
                    reached = self.used(value, env) | env.get(name, set())
                    env[name] = {self.node((stmt,), scope, "definition", name, stmt.lineno, stmt.lineno if self.foreign(value) else 0, reached=reached)} if reached or self.foreign(value) else set()
                case ast.For(target=target, iter=value) | ast.AsyncFor(target=target, iter=value):
                    self.define(stmt, target, value, env, scope, self.flow)
            if not self.flow:
                self.sinks(stmt, head, env, scope)
            self.inside(stmt, env, scope)
        return env

    def inside(self, stmt: ast.stmt, env: dict[str, set[int]], scope: str) -> None:
        parts = [getattr(stmt, "body", None), getattr(stmt, "orelse", None), getattr(stmt, "finalbody", None), *(h.body for h in getattr(stmt, "handlers", ()))]
        if not isinstance(stmt, _COMPOUND) or isinstance(stmt, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            return
        if not self.flow:
            if not isinstance(stmt, ast.AsyncWith):
                for part in parts:
                    self.read(part or [], env, scope)
            return
        join = lambda *envs: {n: set().union(*(e.get(n, ()) for e in envs)) for n in {n for e in envs for n in e}}
        if isinstance(stmt, ast.If):
            after = join(self.read(stmt.body, dict(env), scope), self.read(stmt.orelse, dict(env), scope))
        elif isinstance(stmt, (ast.While, ast.For, ast.AsyncFor)):
            after = dict(env)
            while (more := join(after, self.read(stmt.body, dict(after), scope))) != after:
                after = more
            if isinstance(stmt, ast.While):
                self.sinks(stmt, [stmt.test], after, scope)
            after = self.read(stmt.orelse, dict(after), scope)
        elif isinstance(stmt, ast.Try):
            tried = self.read(stmt.body, dict(env), scope)
            caught = [self.read(h.body, join(env, tried), scope) for h in stmt.handlers]
            after = self.read(stmt.finalbody, join(self.read(stmt.orelse, dict(tried), scope), *caught), scope)
        else:
            after = self.read(stmt.body, dict(env), scope)
        env.clear()
        env.update(after)


def nodes(df: DataFrame, key: str = "path", text: str = "text", flow: bool = False) -> DataFrame:
    """The facts of every text: key, node, scope, kind, name, line, source (its line, or 0), sink, cleaned, killed and reached_by."""
    fields = f"{key} {dict(df.dtypes)[key]}, node int, scope string, kind string, name string, line int, source int, sink string, cleaned boolean, killed array<string>, reached_by array<int>"
    types = [None, pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = Facts(raw or "", flow).nodes
                except (SyntaxError, ValueError, RecursionError):
                    continue
                rows += [(k, i, *n[:-1], sorted(n[-1])) for i, n in enumerate(found)]
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t or batch.schema.field(0).type) for c, t in zip(columns, types)], names=["key", "node", "scope", "kind", "name", "line", "source", "sink", "cleaned", "killed", "reached_by"])

    return df.select(key, text).distinct().mapInArrow(run, fields.replace(key, "key", 1)).withColumnRenamed("key", key)


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closure(facts: DataFrame, key: str = "path") -> DataFrame:
    """key, node, sink (the kind), source_line and steps of all tainted nodes, by semi-naive rounds of joins."""
    kinds = facts.where("kind = 'sink'").select(key, "sink").distinct()
    edges = _kept(facts.select(key, F.explode("reached_by").alias("node"), F.col("node").alias("next"), "killed"), "taint-edges")
    new = facts.where("source > 0").join(kinds.withColumnRenamed("sink", "of"), key).where("NOT array_contains(killed, of)").select(key, "node", F.col("of").alias("sink"), F.col("source").alias("source_line"), F.lit(0).alias("steps"))
    new = _kept(new, "taint-round")
    seen, steps = new, 0
    while not new.isEmpty():
        steps += 1
        found = new.join(edges, [key, "node"]).where("NOT array_contains(killed, sink)").groupBy(key, F.col("next").alias("node"), "sink").agg(F.min("source_line").alias("source_line"))
        new = _kept(found.join(seen, [key, "node", "sink"], "left_anti").withColumn("steps", F.lit(steps)), "taint-round")
        seen = seen.unionByName(new)
    return seen


def taint_flows(df: DataFrame, key: str = "path", text: str = "text", flow: bool = False) -> DataFrame:
    """key, sink, cwe_id, severity, name (of the call), source_line, sink_line, steps and cleaned (every statement that holds the call is clean) of all flows."""
    facts = _kept(nodes(df, key, text, flow), "taint-facts")
    tainted = closure(facts, key)
    hit = facts.where("kind = 'sink'").join(tainted, [key, "node", "sink"])
    of = lambda i: F.create_map(*(F.lit(x) for k, v in SINKS.items() for x in (k, v[i])))[F.col("sink")]
    each = hit.groupBy(key, "sink", "name", F.col("line").alias("sink_line")).agg(F.min(F.struct("steps", "source_line")).alias("s"), F.bool_and("cleaned").alias("cleaned"))
    return each.select(key, "sink", of(1).alias("cwe_id"), of(0).alias("severity"), "name", F.col("s.source_line").alias("source_line"), "sink_line", F.col("s.steps").alias("steps"), "cleaned")


#: Functions with planted flows, each as a text, and its flows both ways: sink, call, line of the source and of the sink, and
#: whether it is cleaned, or only "ordered" has it.
PLANTED = (
    ("def run(cmd):\n    if cmd:\n        line = cmd\n    else:\n        line = 'ls'\n    os.system(line)", (("command_injection", "os.system", 1, 6, False, ""),)),
    ("def run(cmd):\n    line = cmd\n    line = 'ls'\n    os.system(line)", (("command_injection", "os.system", 1, 4, False, "ordered"),)),
    ("def run():\n    a = ''\n    b = ''\n    while more():\n        os.system(b)\n        b = a\n        a = input()\n    done()", (("command_injection", "os.system", 7, 5, False, "flow"),)),
    ("def run(url):\n    safe = urlparse(url)\n    requests.get(safe)\n    requests.post(url)", (("ssrf", "requests.get", 1, 3, False, "ordered"), ("ssrf", "requests.post", 1, 4, False, ""))),
    ("def run(self, name, *rest):\n    db.execute('SELECT %s', name)\n    db.execute('SELECT ' + name)", (("sql_injection", "db.execute", 1, 2, True, ""), ("sql_injection", "db.execute", 1, 3, False, ""))),
    ("def run(conn):\n    for row in conn.recv(9):\n        exec(row)", (("command_injection", "exec", 2, 3, False, ""), ("code_injection", "exec", 2, 3, False, ""))),
    ("def run(a):\n    b = a\n    c = b\n    d = c\n    tree.xpath(query=d)", (("xpath_injection", "tree.xpath(query=...)", 1, 5, False, ""),)),
    ("def run():\n    x = 1\n    try:\n        x = os.environ['A']\n    except KeyError:\n        x = 2\n    getattr(obj, x)", (("code_injection", "getattr", 4, 7, False, ""),)),
)


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python files made from the parts, each with one of the planted functions behind size modulo 4 lines; every 11th does not parse."""
    k = F.col("p_partkey")
    own = F.element_at(F.array(*(F.lit(t) for t, _ in PLANTED)), (k % len(PLANTED)).cast("int") + 1)
    text = F.concat(F.repeat(F.lit("x = 0\n"), (F.col("p_size") % 4).cast("int")), own, F.when(k % 11 == 0, "\ndef broken(:").otherwise(""))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("src/p"), k.cast("string"), F.lit(".py")).alias("path"), text.alias("text"))


def _flows_sql(way: str) -> str:
    rows = ", ".join(f"({i}, '{sink}', '{SINKS[sink][1]}', '{SINKS[sink][0]}', '{name}', {source}, {line}, {str(cleaned).lower()})" for i, (_, flows) in enumerate(PLANTED) for sink, name, source, line, cleaned, only in flows if only in ("", way))
    return f"SELECT 'src/p' || p_partkey || '.py' AS path, f.sink, f.cwe_id, f.severity, f.name, cast(f.source_line + p_size % 4 as int) AS source_line, cast(f.sink_line + p_size % 4 as int) AS sink_line, f.cleaned FROM part JOIN (VALUES {rows}) f(k, sink, cwe_id, severity, name, source_line, sink_line, cleaned) ON f.k = p_partkey % {len(PLANTED)} WHERE p_partkey % 11 <> 0"


@query("txt10_taint_ordered", _flows_sql("ordered"))
def txt10_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint_flows(planted(spark, sf_dir)).drop("steps")


@query("txt10_taint_flow", _flows_sql("flow"))
def txt10_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With branches joined, loops, and assignments and cleaners that end a flow."""
    return taint_flows(planted(spark, sf_dir), flow=True).drop("steps")


@query("agg42_flow_summary", f"SELECT sink, severity, cleaned, count(*) AS n, count(DISTINCT path) AS files FROM ({_flows_sql('ordered')}) GROUP BY ALL")
def agg42_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint_flows(planted(spark, sf_dir)).groupBy("sink", "severity", "cleaned").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))
