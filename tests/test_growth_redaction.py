"""Redaction tries each pattern only where a match can lie, and finds what the patterns find in whole texts."""

from __future__ import annotations

import contextlib
import io
import random
import re

from quillon.operators import governance

BITS = ("password", "PASSWD", "pwd", "ſecret", "toKen", "api_key", "api-key", "bearer", ":", "=", " ", "\n", "'", "@", "a@b.com", "x.y+z@", ".co", ".", "-", "_", "+", "(", ")", "1", "12", "1234", "4111 1111 1111 1111", "123-45-6789", "10.0.0.1", "+1 (555) 123-4567", "é", "٣", "A" * 40, "/", "AKIA" + "Z" * 16, "ghp_" + "a" * 20, "xoxb-" + "1" * 10, "sk-" + "q" * 20, "eyJ" + "a" * 10 + ".", "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "abcd")


def test_spans_are_those_of_the_patterns_over_the_whole_text():
    dice, found = random.Random(7), 0
    for _ in range(4000):
        text = "".join(dice.choice(BITS) for _ in range(dice.randint(1, 14)))
        want = [(kind, *m.span()) for kind, p in governance.REDACTIONS for m in re.finditer(p, text) if kind != "CREDIT_CARD" or governance.luhn(m.group())]
        want += [("SECRET", *m.span(2)) for m in re.finditer(governance.KEY_VALUE, text)]
        assert list(governance._spans(text)) == want
        found += len(want)
    assert found > 1000


def test_texts_are_not_searched_before_they_are_redacted(spark):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        governance.redacted(spark.createDataFrame([("a",)], "text string")).explain()
    assert "RLIKE" not in said.getvalue()
