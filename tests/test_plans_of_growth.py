"""Joins of what grows with the input are no broadcasts, however small a file seems to the planner."""

from __future__ import annotations

import contextlib
import io

from quillon.operators import blocks


def test_checks_of_manifests_send_no_documents_through_the_driver(spark, sf_dir):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        blocks.txt11_kubernetes(spark, sf_dir).explain()
    assert "Join" in said.getvalue() and "Broadcast" not in said.getvalue()
