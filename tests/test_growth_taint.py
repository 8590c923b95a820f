"""A text's flows cost in proportion to it, and are those of a replay that walks every statement anew."""

from __future__ import annotations

import ast

from pyspark.sql import Row

from quillon.operators import detectors

CHAIN = "def f(a):\n    x = get()\n    if a:\n        pass\n" + "".join(f"    elif a == {i}:\n        x = {'escape(x)' if i % 7 == 3 else 'x + 1'}\n        eval(x)\n" for i in range(120))
TEXTS = [
    CHAIN, "", None, "def broken(:", "x = 1\neval(x)", "eval(input())", "a = b = input()\nsystem(a, escape(b))\na = get(a)\nexec(a)",
    "x = input()\ndef f(y):\n    eval(x)\n    try:\n        y = form[0]\n    except E:\n        loads([y], k=y)\n    async def g():\n        popen(y)\n        y = quote(y)\n        return lambda: popen(y)\n",
    "class C:\n    @dec(eval(input()))\n    def m(self):\n        match self.read():\n            case {'k': v}:\n                v = self.read()\n                self.db.execute(f'{v}', {**v})\n        global z\n        z = {None: v, **v}\n        execute(z if not z else int(z))",
]


def replayed(text):
    try:
        tree = ast.parse(text or "")
    except SyntaxError:
        return []
    name, out = detectors._name, set()
    for scope in [tree, *(n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)))]:
        tainted = {}

        def of(expr):
            calls = [n for n in ast.walk(expr) if isinstance(n, (ast.Call, ast.Subscript, ast.Attribute))]
            cleaned = any(isinstance(n, ast.Call) and name(n) in detectors.CLEANERS for n in calls)
            for n in ast.walk(expr):
                if isinstance(n, ast.Name) and n.id in tainted:  # noqa: B023 - used in this turn only
                    return tainted[n.id][0], tainted[n.id][1] or cleaned  # noqa: B023
            return next(((n.lineno, cleaned) for n in calls if name(n) in detectors.SOURCES), None)

        for s in (n for n in ast.walk(scope) if isinstance(n, ast.stmt) and n is not scope):
            for n in ast.walk(s):
                if isinstance(n, ast.Call) and name(n) in detectors.SINKS:
                    out |= {(name(n), detectors.SINKS[name(n)], got[0], n.lineno, got[1]) for a in n.args if (got := of(a)) is not None}
            if isinstance(s, ast.Assign) and (got := of(s.value)) is not None:
                tainted |= {t.id: got for t in s.targets if isinstance(t, ast.Name)}
    return sorted(out)


def test_flows_are_those_of_the_replay(spark):
    df = spark.createDataFrame([Row(k=i, text=t) for i, t in enumerate(TEXTS)], "k int, text string")
    got = sorted(tuple(r) for r in detectors.flows(df, "k").collect())
    assert got == sorted((i, *r) for i, t in enumerate(TEXTS) for r in replayed(t)) and len(got) > 100
    assert {r[0] for r in got} >= {0, 5, 6, 7, 8} and not {r[0] for r in got} & {1, 2, 3, 4}


def test_calls_in_a_long_chain_are_named_a_few_times_each(monkeypatch):
    asked, name = [], detectors._name
    monkeypatch.setattr(detectors, "_name", lambda n: asked.append(n) or name(n))
    detectors.taint_flows(CHAIN)
    assert len(asked) < 3 * sum(isinstance(n, ast.Call) for n in ast.walk(ast.parse(CHAIN)))


def test_matches_of_true_and_false_are_read(spark):
    """A pattern True or False stands in the tree as a bool, which has no parts."""
    text = "x = input()\nmatch x:\n    case True | False | None:\n        eval(x)\n    case {'k': True, **rest}:\n        exec(escape(x))\n"
    assert replayed(text) == [("eval", "CWE-94", 1, 4, False), ("exec", "CWE-94", 1, 6, True)]
    df = spark.createDataFrame([Row(k=1, text=text)], "k int, text string")
    assert sorted(tuple(r) for r in detectors.flows(df, "k").collect()) == [(1, *r) for r in replayed(text)]
