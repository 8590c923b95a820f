"""Extents against programs that are written together with what they hold."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillon.operators import extents

DECOYS = {
    "js": ["let s = '} {';", 'let s = "\\"{";', "// } function no() {", "/* class X {\n } */", "let t = `${a} {\n}`;", "x = a && b;", "call({a: 1});"],
    "java": ['String s = "} {";', "char c = '{';", "// } void no() {", "/* class X {\n } */", 'String t = """\n } " {\n""";', "x = a || b;", "int[] a = {1, 2};"],
    "go": ['s := "} {"', "c := '{'", "// } func no() {", "/* type X struct {\n } */", "t := `{\n`", "x = a && b", "m := map[string]int{}"],
}
BRANCH = {"js": "if (x) {", "java": "for (int i : y) {", "go": "if x {"}


def function(language, name, rng):
    if language == "js":
        return rng.choice([("function", f"function {name}(a, b = f(1)) {{"), ("function", f"const {name} = async (a) => {{"), ("method", f"{name}(a) {{"), ("function", f"let {name} = function (x) {{")])
    if language == "java":
        return "method", rng.choice([f"public static Map<A, B> {name}(int a) throws X {{", f"void {name}()\n{{", f"{name.title()}(String... a) {{".replace(name.title(), name)])
    return "function", rng.choice([f"func {name}(a int) (b interface{{}}, c error) {{", f"func (s *T) {name}() {{", f"func {name}[K any](k K) struct{{}} {{"])


def program(language, rng):
    lines, found = [], []

    def emit(text):
        lines.extend(text.split("\n"))

    def decisions(a, b):  # decoys and branches count one each
        return sum(("&&" in x or "||" in x or x.strip() == BRANCH[language]) and not x.strip().startswith("//") for x in lines[a:b])

    def block(depth):
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.5 or depth > 3:
                emit(rng.choice(DECOYS[language]))
            elif kind < 0.7:
                emit(BRANCH[language])
                block(depth + 1)
                emit("}")
            else:
                name = f"f{len(lines)}x{depth}"
                what, head = function(language, name, rng)
                start = len(lines)
                emit(head)
                block(depth + 1)
                emit("}")
                found.append((what, name, start + 1, len(lines), 1 + decisions(start, len(lines))))

    block(0)
    return "\n".join(lines), found


def test_random_programs(spark):
    rng = random.Random(3)
    rows, want = [], []
    for i in range(120):
        language = rng.choice(["js", "java", "go"])
        text, found = program(language, rng)
        rows.append((f"p{i}.{language}", text))
        want += [(f"p{i}.{language}", *f) for f in found]
    rows += [("none.js", None), ("empty.go", ""), ("other.py", "def f(): {"), rows[0]]
    got = extents.extents(spark.createDataFrame(rows, "path string, text string")).where("kind <> 'class'")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 100


def test_openings_without_an_end(spark):
    df = spark.createDataFrame([("a.js", "}\nfunction f() {\n  if (x) {\n}\n\n")], "path string, text string").withColumn("line", F.lit(1))
    assert [tuple(r) for r in extents.extents(df).collect()] == [("a.js", "function", "f", 2, 6, 2)]


def test_ruby(spark):
    text = 'class A\n  # def no\n  def a\n    x.each do |y|\n      y.z if y\n    end\n    until b\n      c\n    end\n  end\n  def end?; true; end\nend\nmodule M\nend'
    got = {(r.name, r.start, r.stop) for r in extents.extents(spark.createDataFrame([("a.rb", text)], "path string, text string")).collect()}
    assert got == {("A", 1, 12), ("a", 3, 10), ("end?", 11, 11), ("M", 13, 14)}
