"""The graph of imports against a search in Python."""

from __future__ import annotations

import random

from quillon.operators import imports

FILES = [
    ("app/__init__.py", "from . import core\nfrom .core import tools as t"), ("app/core/__init__.py", "from .tools import run, stop\nimport json"), ("app/core/tools.py", "from ..web import *\nimport app.core.tools"), ("app/web.py", "import os.path, app.core"),
    ("main.py", "import app\nimport app.web as w"), ("lonely.py", "def ("), ("none.py", None), ("main.py", "import app\nimport app.web as w"),
]


def test_edges(spark):
    got = {(r.path, r.name, r.to, r.line) for r in imports.import_edges(spark.createDataFrame(FILES, "path string, text string")).collect()}
    assert got == {
        ("app/__init__.py", "app.core", "app/core/__init__.py", 1), ("app/__init__.py", "app.core.tools", "app/core/tools.py", 2),
        ("app/core/__init__.py", "app.core.tools.run", "app/core/tools.py", 1), ("app/core/__init__.py", "app.core.tools.stop", "app/core/tools.py", 1), ("app/core/__init__.py", "json", None, 2),
        ("app/core/tools.py", "app.web", "app/web.py", 1), ("app/core/tools.py", "app.core.tools", "app/core/tools.py", 2),
        ("app/web.py", "os.path", None, 1), ("app/web.py", "app.core", "app/core/__init__.py", 1),
        ("main.py", "app", "app/__init__.py", 1), ("main.py", "app.web", "app/web.py", 2),
    }


def test_reach_against_breadth_first_search(spark):
    rng = random.Random(7)
    edges = [(str(rng.randrange(60)), str(rng.randrange(60))) for _ in range(110)] + [("1", None)]
    distance, frontier = {"0": 0, "5": 0}, ["0", "5"]
    while frontier:
        frontier = [b for a, b in edges if a in frontier and b and b not in distance and not distance.setdefault(b, distance[a] + 1) == 0]
    got = imports.reach(spark.createDataFrame(edges, "path string, to string"), spark.createDataFrame([("0",), ("5",), ("0",)], "e string"))
    assert sorted((r.path, r.distance) for r in got.collect()) == sorted(distance.items())
    assert imports.reach(spark.createDataFrame(edges, "path string, to string").limit(0), spark.createDataFrame([("0",)], "e string")).count() == 1
