"""Scans of text by catalogs of expressions, at a cost that hardly depends on the number of rules.

Every rule's expression is read once for what any match must contain: the longest run of letters that it cannot do
without, or one of several such runs where it has alternatives. One automaton of all runs (Aho-Corasick) goes over a text
once; only the rules whose run stands in a line are tried on that line. Rules without a run of LEAST characters are tried
on every line that is long enough for them. Scans of whole texts (rules that span lines) try a rule on texts that hold
its run, and find a match's line by binary search among the line ends.

Letters are compared as expressions compare them in any case: ASCII letters by their lower case, and the four others that
stand for i, s and k there. So the runs never miss a match.

Cases: a null text has no lines; columns of df other than the text are kept; equal rows give equal hits; an expression
that does not compile is an error; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from re import _constants as op  # what re itself reads expressions with
from re import _parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.catalog import query
from quillon.operators.catalogs import every_rule
from quillon.sources.tables import table

Rule = tuple[str, str, str, str]
#: Characters of a run that the automaton looks for; rules of a table at most; rows of an Arrow batch of whole texts.
LEAST, MOST_RULES, ROWS = 3, 10_000, 500
#: Weaknesses that count in comment lines too; what begins such a line.
IN_COMMENTS, COMMENT = ("CWE-798",), ("//", "#", "*")
_FOLD = {i: i + 32 for i in range(65, 91)} | {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}


def fold(text: str) -> str:
    """Letters by their lower case as expressions compare them; every character stays one."""
    return text.translate(_FOLD)


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    weigh = lambda x: (min(map(len, x)), -len(x)) if x else (0, 0)
    return a if weigh(a) >= weigh(b) else b


def _needed(items: object) -> frozenset[str] | None:
    """Runs of which every match holds one, for a part of an expression; nothing if there is none."""
    best, run = None, ""
    for kind, value in items:
        inner = None
        if kind is op.LITERAL and fold(chr(value)) != "\n":
            run += fold(chr(value))
            continue
        if kind is op.SUBPATTERN:
            inner = _needed(value[-1])
            if all(k is op.LITERAL for k, _ in value[-1]):  # a group of plain characters goes on
                run += "".join(fold(chr(v)) for _, v in value[-1])
                continue
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = _needed(value[2])
        elif kind is op.BRANCH:
            each = [_needed(b) for b in value[1]]
            inner = None if None in each else frozenset().union(*each)
        elif kind is op.AT:  # anchors have no width
            continue
        best = _better(_better(best, frozenset([run]) if run else None), inner)
        run = ""
    return _better(best, frozenset([run]) if run else None)


def required(expression: str) -> frozenset[str] | None:
    """Folded strings of which every match of an expression holds at least one; nothing if that cannot be told."""
    return _needed(_parser.parse(expression))


def example(expression: str) -> str:
    """A string that an expression matches: first alternatives, least repeats, and the first allowed characters."""

    def of(items: object) -> str:
        out = []
        for kind, value in items:
            if kind is op.LITERAL:
                out.append(chr(value))
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
                out.append(of(value[2]) * value[0])
            elif kind is op.SUBPATTERN:
                out.append(of(value[-1]))
            elif kind is op.BRANCH:
                out.append(of(value[1][0]))
            elif kind is op.IN:
                out.append(next(c for c in "aA0b1x7_- " if re.fullmatch(_class(value), c)) if _class(value) else chr(value[0][1]))
            elif kind is op.ANY:
                out.append("a")
            elif kind is op.NOT_LITERAL:
                out.append("a" if value != ord("a") else "b")
        return "".join(out)

    def _class(value: list) -> str:
        parts = []
        for kind, v in value:
            parts.append("^" if kind is op.NEGATE else re.escape(chr(v)) if kind is op.LITERAL else f"{re.escape(chr(v[0]))}-{re.escape(chr(v[1]))}" if kind is op.RANGE else {op.CATEGORY_DIGIT: r"\d", op.CATEGORY_WORD: r"\w", op.CATEGORY_SPACE: r"\s"}[v])
        return f"[{''.join(parts)}]" if re.search(f"[{''.join(parts)}]", "aA0b1x7_- ") else ""

    return of(_parser.parse(expression))


class Prefilter:
    """An automaton over the runs of all rules, and the rules that have none."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.expressions = [re.compile(r[1]) for r in rules]
        self.width = [_parser.parse(r[1]).getwidth()[0] for r in rules]
        runs: dict[str, list[int]] = {}
        self.loose = []
        for i, r in enumerate(rules):
            found = required(r[1])
            if not found or min(map(len, found)) < LEAST:
                self.loose.append(i)
            for run in found if found and i not in self.loose[-1:] else ():
                runs.setdefault(run, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for run, which in runs.items():
            self.automaton.add_word(run, (tuple(which)))
        self.automaton.make_automaton()
        self.any = bool(runs)

    def lines(self, text: str, window: int = 1) -> Iterator[tuple[int, int, int]]:
        """Line (from 0), rule and column (from 0) of the first match of every rule in every line, or in as many lines from each one on as window says."""
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        ends = [*(s - 1 for s in starts[1:]), len(text)]
        wanted: set[tuple[int, int]] = set()
        if self.any:
            for end, which in self.automaton.iter(fold(text)):
                at = bisect_right(starts, end) - 1
                wanted.update((w, i) for w in range(max(0, at - window + 1), at + 1) for i in which)
        last = lambda at: ends[min(at + window, len(ends)) - 1]
        wanted.update((at, i) for at, a in enumerate(starts) for i in self.loose if last(at) - a >= self.width[i])
        for at, i in sorted(wanted):
            found = self.expressions[i].search(text[starts[at] : last(at)])
            if found:
                yield at, i, found.start()

    def spans(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Rule, first and last line (from 0) of all matches of every rule in the whole text, in order of the rules."""
        seen = {i for _, which in self.automaton.iter(fold(text)) for i in which} if self.any else set()
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        for i in sorted(seen.union(self.loose)):
            for m in self.expressions[i].finditer(text):
                yield i, bisect_right(starts, m.start()) - 1, bisect_right(starts, max(m.start(), m.end() - 1)) - 1


def rules_of(df: DataFrame) -> tuple[Rule, ...]:
    """The rules of a table of rule, expression, severity and cwe_id, in order of rule; at most MOST_RULES of them."""
    rows = df.select("rule", "expression", "severity", "cwe_id").orderBy("rule").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return tuple(tuple(r) for r in rows)


def _scanned(df: DataFrame, text: str, rules: Sequence[Rule], whole: bool, window: int = 1, comments: bool = False) -> DataFrame:
    kept = [f for f in df.schema if f.name not in (text, "line_number", "last_line", "column", "rule", "severity", "cwe_id")]
    more = [("line_number", T.IntegerType()), ("last_line" if whole else "column", T.IntegerType()), ("rule", T.StringType()), ("severity", T.StringType()), ("cwe_id", T.StringType())]
    names = [f.name for f in kept] + [n for n, _ in more]
    spark = df.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, str(ROWS))  # batches of whole texts stay small
    rules = tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Prefilter(rules)
        for batch in batches:
            row, first, second, which = [], [], [], []
            for n, raw in enumerate(batch.column(0).to_pylist()):
                if not raw:
                    continue
                if whole:
                    for i, a, b in ready.spans(raw):
                        row.append(n), first.append(a + 1), second.append(b + 1), which.append(i)
                else:
                    lines = raw.split("\n")
                    for at, i, column in ready.lines(raw, window):
                        if comments or rules[i][3] in IN_COMMENTS or not lines[at].strip().startswith(COMMENT):
                            row.append(n), first.append(at + 1), second.append(column + 1), which.append(i)
            taken = batch.slice(0).take(pa.array(row, pa.int64())).columns[1:]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(first, pa.int32()), pa.array(second, pa.int32()), *(pa.array([rules[i][k] for i in which], pa.string()) for k in (0, 2, 3))], names=names)

    return df.select(F.col(f"`{text}`").alias("__text"), *(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, T.StructType([*kept, *(T.StructField(n, t) for n, t in more)]))


def scan_lines(df: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text", window: int = 1, comments: bool = False) -> DataFrame:
    """df without its text, and a row for each line and rule that matches there: line_number, column (of the first match), rule, severity, cwe_id.

    Comment lines count only for weaknesses of IN_COMMENTS, unless comments are asked for. rules: by default those of all
    catalogs. window: lines that a rule is tried on from each line on.
    """
    return _scanned(df, text, every_rule() if rules is None else rules, False, window, comments)


def scan_texts(df: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """df without its text, and a row for each match of a rule in a whole text: line_number, last_line, rule, severity, cwe_id."""
    return _scanned(df, text, rules, True)


def hits_sql(rules: Sequence[Rule], lines: str, keys: str, more: str = "") -> str:
    # DuckDB's \\b knows ASCII letters only; here it only stands at an expression's ends
    before, after = r"(?:^|[^\pL\pN_])", r"(?:[^\pL\pN_]|$)"
    words = lambda e: re.sub(r"\\b$", lambda _: after, re.sub(r"^(\(\?i\))?\\b", lambda m: (m[1] or "") + before, e))
    quoted = lambda e: words(e).replace("'", "''")
    return " UNION ALL ".join(f"SELECT {keys}, '{r}' AS rule, '{s}' AS severity, '{c}' AS cwe_id{more} FROM {lines} WHERE regexp_matches(line, '{quoted(e)}')" + ("" if c in IN_COMMENTS else " AND NOT comment") for r, e, s, c in rules)


LINES_SQL = "SELECT {keys}, line, line_number, starts_with(ltrim(line), '//') OR starts_with(ltrim(line), '#') OR starts_with(ltrim(line), '*') AS comment FROM (SELECT {keys}, unnest(string_split({text}, chr(10))) AS line, cast(generate_subscripts(string_split({text}, chr(10)), 1) as int) AS line_number FROM {table})"


@query("txt05_catalogs_documents", "WITH lines AS MATERIALIZED (" + LINES_SQL.format(keys="doc_id", text="text", table="documents") + ") " + hits_sql(every_rule(), "lines", "doc_id, line_number"))
def txt05_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All catalogs over the documents."""
    return scan_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("column")


@query("txt05_catalogs_pages", "WITH lines AS MATERIALIZED (" + LINES_SQL.format(keys="page_id", text="html", table="pages") + ") " + hits_sql(every_rule(), "lines", "page_id, line_number"))
def txt05_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All catalogs over the raw pages."""
    return scan_lines(table(spark, sf_dir, "pages").select("page_id", "html"), text="html").drop("column")


def planted(spark: SparkSession, sf_dir: str, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Source files made from the parts: each holds an example of one rule, every fourth one in a comment."""
    rules = every_rule() if rules is None else rules
    k, lines = F.col("p_partkey"), F.array(*(F.lit(example(r[1])) for r in rules))
    own = F.element_at(lines, (k % len(rules)).cast("int") + 1)
    text = F.concat_ws("\n", F.lit("def run(value):"), F.lit("    total = 0"), F.concat(F.when(k % 4 == 3, "  # ").otherwise("    x; "), own), F.lit("    return total"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


def _planted_sql(rules: Sequence[Rule]) -> str:
    values = ", ".join(f"({i}, '{example(r[1]).replace(chr(39), chr(39) * 2)}')" for i, r in enumerate(rules))
    samples = f"WITH samples AS (SELECT k, line, false AS comment FROM (VALUES {values}) v(k, line)), spoken AS (SELECT k, c.before || line AS line, c.comment FROM samples, (VALUES ('    x; ', false), ('  # ', true)) c(before, comment)), hits AS (" + hits_sql(rules, "spoken", "k, comment") + ") "
    return samples + f"SELECT p_partkey, 3 AS line_number, h.rule, h.severity, h.cwe_id FROM part JOIN hits h ON h.k = p_partkey % {len(rules)} AND h.comment = (p_partkey % 4 = 3)"


@query("txt05_catalogs_planted", _planted_sql(every_rule()))
def txt05_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All catalogs over files that hold an example of every rule."""
    return scan_lines(planted(spark, sf_dir)).drop("column")
