"""Taint flows against a replay of statements, and planted branches, loops, parameters and cleaners."""

from __future__ import annotations

import ast
import random
import re

from quillon.operators import taint


def replay(text):
    """Flows by walking each scope's statements in order with a set of tainted names: sink, call, line of the call, cleaned."""
    lines, out = text.split("\n"), {}

    def statements(body):
        for s in body:
            yield s
            if isinstance(s, (ast.If, ast.While, ast.For, ast.With, ast.Try)):
                for part in (s.body, getattr(s, "orelse", []), getattr(s, "finalbody", []), *(h.body for h in getattr(s, "handlers", []))):
                    yield from statements(part)

    def names(node):
        return {n.id for n in ast.walk(node) if isinstance(n, ast.Name)}

    def call_name(node):
        parts = []
        while isinstance(node, ast.Attribute):
            parts.insert(0, node.attr)
            node = node.value
        return ".".join([node.id, *parts] if isinstance(node, ast.Name) else parts)

    tree = ast.parse(text)
    scopes = [(tree.body, set())] + [(f.body, {a.arg for a in (*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs, *filter(None, (f.args.vararg, f.args.kwarg)))} - {"self", "cls"}) for f in ast.walk(tree) if isinstance(f, ast.FunctionDef)]
    for body, tainted in scopes:
        for s in statements(body):
            assigned = [(t, s.value) for t in s.targets] if isinstance(s, ast.Assign) else [(s.target, s.iter)] if isinstance(s, ast.For) else []
            for target, value in assigned:
                name = next((n.id for n in (target.elts if isinstance(target, ast.Tuple) else [target]) if isinstance(n, ast.Name)), None)
                source = any(re.search(p, lines[value.lineno - 1]) for p in taint.SOURCES)
                if name and (source or isinstance(s, ast.Assign) and names(value) & tainted):
                    tainted.add(name)
            for call in (n for n in ast.walk(s) if isinstance(n, ast.Call)):
                for kind, (_, _, patterns) in taint.SINKS.items():
                    if call_name(call.func) and any(re.search(p, call_name(call.func) + "(") for p in patterns):
                        for arg, value in [*((None, a) for a in call.args), *((k.arg, k.value) for k in call.keywords)]:
                            if names(value) & tainted:
                                key = kind, call_name(call.func) + (f"({arg}=...)" if arg else ""), call.lineno
                                clean = taint.cleans(kind, "\n".join(lines[s.lineno - 1 : s.end_lineno]))
                                out[key] = out.get(key, True) and clean
    return {(*k, v) for k, v in out.items()}


def some_function(rng, depth=0):
    names = ["a", "b", "c", "d"]
    values = [lambda: "input()", lambda: "'x'", lambda: f"{rng.choice(names)} + 'y'", lambda: f"int({rng.choice(names)})", lambda: f"f({rng.choice(names)}, {rng.choice(names)})"]
    calls = ["os.system({})", "db.execute('%s', {})", "exec(code={})", "requests.get(urlparse({}))", "x.y().write({})"]
    out = []
    for _ in range(rng.randint(1, 5)):
        kind = rng.random()
        if kind < 0.45:
            out.append(f"{rng.choice(names)} = {rng.choice(values)()}")
        elif kind < 0.75 or depth > 2:
            out.append(rng.choice(calls).format(rng.choice(names)))
        else:
            head = rng.choice(["if a:", "while b:", f"for {rng.choice(names)} in {rng.choice(['range(3)', 'sys.argv'])}:", "with lock:"])
            out += [head, *("    " + x for x in some_function(rng, depth + 1))]
    return out


def test_ordered_flows_are_the_replay(spark):
    rng = random.Random(9)
    rows = [(f"p{i}", "\n".join([f"def f{i}({rng.choice(['', 'a', 'self, b', '*c'])}):", *("    " + x for x in some_function(rng)), *some_function(rng)])) for i in range(80)]
    rows += [("none", None), ("empty", ""), ("broken", "def ("), ("p0", rows[0][1])]
    got = taint.taint_flows(spark.createDataFrame(rows, "path string, text string")).collect()
    want = {(p, *f) for p, t in rows[:80] for f in replay(t)}
    assert {(r.path, r.sink, r.name, r.sink_line, r.cleaned) for r in got} == want and len(want) > 60
    assert len(got) == len(want)


def found(spark, text, flow=True):
    rows = taint.taint_flows(spark.createDataFrame([("p", text)], "path string, text string"), flow=flow).where("sink = 'command_injection'").collect()
    return {(r.source_line, r.sink_line, r.steps, r.cleaned) for r in rows}


def test_control_flow(spark):
    assert found(spark, "def f(a):\n    b = a\n    b = 1\n    os.system(b)") == set()
    assert found(spark, "def f(a):\n    b = 1\n    if a:\n        b = a\n    os.system(b)") == {(1, 5, 2, False)}
    assert found(spark, "def f(a):\n    if x:\n        a = 1\n    else:\n        a = 2\n    os.system(a)") == set()
    assert found(spark, "b = c = 0\nwhile x:\n    os.system(c)\n    c = b\n    b = input()") == {(5, 3, 2, False)}
    assert found(spark, "def f(a):\n    b = shlex.quote(a)\n    os.system(b)\n    os.popen(a)") == {(1, 4, 1, False)}
    assert found(spark, "def f(a):\n    b = 'ls'\n    b += a\n    os.system(b)") == {(1, 4, 2, False)}
    assert found(spark, "def f(a):\n    try:\n        b = a\n    except E:\n        b = 1\n    finally:\n        os.system(b)") == {(1, 7, 2, False)}
    assert found(spark, "def f(a):\n    os.system(int(a))") == {(1, 2, 1, True)}
    # a cleaner kills its kinds only
    text = "def f(a):\n    b = urlparse(a)\n    os.system(b)\n    requests.get(b)"
    kinds = {r.sink for r in taint.taint_flows(spark.createDataFrame([("p", text)], "path string, text string"), flow=True).collect()}
    assert kinds == {"command_injection"}


def test_tables_are_whole():
    assert len(taint.SOURCES) == 34 and len(taint.SINKS) == 9 and sum(map(len, taint.CLEANERS.values())) == 49
    assert taint.cleans("sql_injection", "db.execute('SELECT %s', x)") and not taint.cleans("sql_injection", "db.execute('SELECT %s' % x)")


def test_long_chains_end(spark):
    text = "def f(v0):\n" + "\n".join(f"    v{i + 1} = v{i}" for i in range(12)) + "\n    os.system(v12)"
    assert found(spark, text, False) == {(1, 14, 13, False)}
