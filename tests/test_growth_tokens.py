"""Tokens of source files are looked for only where one can start, and a declaration's expression is tried once on each."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import extents

BITS = [
    "if", "for", "case", "catch", "x.catch", "$if", "a.if", "éif", "ifé", "_for", "new A<B>() {", "class X {", "interface", "function f(a) {", "const g = async (x) =>", "let h = y => {", "func (b *B) M(k string) {", "func F[T any](a T) {", "type T struct {", "run()\n{", "$r(a){", "é(a) {", ".m(a) {",
    "void m(int a) throws E {", "{", "}", "&&", "||", "&", "|", "?", "?.", "??", "//", "// } {\n", "/* { */", "/*", '"a{"', '"', "'}'", "'", "`{\n`", "`", '"""\n}"""', "\n", " ", "\t", "=", "\\", ";", "$", ".", "1", "=>",
]


@pytest.mark.parametrize("language", ["javascript", "java", "go"])
def test_nothing_is_missed_where_no_token_can_start(spark, language):
    rng = random.Random(5)
    df = spark.createDataFrame([("".join(rng.choice(BITS) + rng.choice(["", " "]) for _ in range(rng.randint(1, 25))),) for _ in range(1500)], "text string")
    every, _ = extents._token(language)
    assert extents._STARTS[language] in every
    guarded, plain = (F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (every, every.replace(extents._STARTS[language], "")))
    r = df.select(F.sum((guarded != plain).cast("int")).alias("missed"), F.sum(F.size(guarded)).alias("n")).first()
    assert r.missed == 0 and r.n > 1500


@pytest.mark.parametrize("language", sorted(extents.LANGUAGES))
def test_each_declaration_is_tried_once(spark, monkeypatch, language):
    kind, asked = type(F.col("t")), []
    rlike = kind.rlike
    monkeypatch.setattr(kind, "rlike", lambda c, p: asked.append(p) or rlike(c, p))
    extents._token(language)[1](F.col("t"))
    assert [asked.count(extents._unfenced(p)) for _, p in extents.LANGUAGES[language][2]] == [1] * len(extents.LANGUAGES[language][2])
