"""Functions and classes of brace languages and Ruby, by prefix sums over tokens.

One expression for each language cuts a text into the tokens that matter: comments and strings (so that what stands inside
them is never seen), declarations up to the brace that opens them, braces, decisions and line ends. Everything after that
is windows over a file's tokens: a running sum of line ends gives a token's line, one of openings less closings its depth,
one of decisions the complexity; of the tokens at one depth openings and closings alternate, so an opening's end is the
next one there.

Cases: a null or empty text has no tokens; an opening without an end ends with the file's last line; closings without an
opening are left out; texts of languages not in LANGUAGES are left out; equal rows count once; an empty table gives no
rows. Not read: expression literals between slashes, and functions without braces but arrows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.sources.tables import dealt, table

_ARGS = r"\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)"
_LINE, _BLOCK = r"//[^\n]*+", r"/\*(?:[^*]++|\*(?!/))*+\*/"
_DOUBLE, _SINGLE, _BACK = r'"(?:[^"\\\n]++|\\.)*+"', r"'(?:[^'\\\n]++|\\.)*+'", r"`(?:[^`\\]++|\\[\s\S])*+`"
_NOT_NAMES = r"(?!(?:if|for|while|switch|catch|with|function|return|do|else|try|new|super|synchronized|throw|typeof|await|in|of)\b)"
_TYPE = r"(?:\s*:\s*[\w<>|\[\].\s,]+?)?"
#: Extensions; comments and strings; declarations by kind, each with a group for the name; tokens that open and close; decisions.
LANGUAGES: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[tuple[str, str], ...], str, str, str]] = {
    "javascript": (
        ("js", "jsx", "ts", "tsx", "mjs", "cjs"), (_LINE, _BLOCK, _DOUBLE, _SINGLE, _BACK),
        (
            ("function", rf"(?<![\w$.])function\s*\*?\s*([\w$]+)\s*{_ARGS}{_TYPE}\s*\{{"),
            ("function", rf"(?<![\w$.])(?:const|let|var)\s+([\w$]+)\s*=\s*(?:async\s+)?(?:function\s*\*?\s*[\w$]*\s*{_ARGS}{_TYPE}|(?:{_ARGS}{_TYPE}|[\w$]+)\s*=>)\s*\{{"),
            ("class", r"(?<![\w$.])class\s+([\w$]+)[^{;]*+\{"),
            ("method", rf"(?<![\w$.]){_NOT_NAMES}([\w$]+)\s*{_ARGS}{_TYPE}\s*\{{"),
            ("arrow", rf"(?<![\w$.])(?:const|let|var)\s+([\w$]+)\s*=\s*(?:async\s+)?(?:{_ARGS}{_TYPE}|[\w$]+)\s*=>"),
        ),
        r"\{", r"\}", r"(?<![\w$])(?:if|for|while|case|catch)(?![\w$])|&&|\|\||\?(?![.?:])",
    ),
    "java": (
        ("java",), (_LINE, _BLOCK, r'"""(?:[^"]++|"(?!""))*+"""', _DOUBLE, _SINGLE),
        (
            ("class", r"(?<![\w$.])(?:class|interface|enum|record)\s+(\w+)[^{;]*+\{"),
            ("", rf"(?<![\w$.])new\s+[\w.<>,\s]+?{_ARGS}\s*\{{"),
            ("method", rf"(?<![\w$.]){_NOT_NAMES}(\w+)\s*{_ARGS}\s*(?:throws\s+[\w.,\s]+?)?\{{"),
        ),
        r"\{", r"\}", r"(?<![\w$])(?:if|for|while|case|catch)(?![\w$])|&&|\|\||\?(?![.?:>,])",
    ),
    "go": (
        ("go",), (_LINE, _BLOCK, _DOUBLE, r"`[^`]*+`", r"'(?:[^'\\\n]++|\\.)*+'"),
        (("function", rf"(?<!\w)func\s+(?:\([^)]*+\)\s*)?(\w+)\s*(?:\[[^\]]*+\])?\s*{_ARGS}(?:interface\{{\}}|struct\{{\}}|[^{{\n])*+\{{"), ("class", r"(?<!\w)type\s+(\w+)\s+(?:struct|interface)\s*\{")),
        r"\{", r"\}", r"(?<!\w)(?:if|for|case|select)(?!\w)|&&|\|\|",
    ),
    "ruby": (
        ("rb",), (r"#[^\n]*+", r'"(?:[^"\\]++|\\[\s\S])*+"', r"'(?:[^'\\]++|\\[\s\S])*+'"),
        (("function", r"(?<![\w.:@])def\s+(?:self\.)?([\w?!=]+)"), ("class", r"(?<![\w.:@])(?:class|module)\s+(\w+)"), ("", r"(?m)^[\x20\t]*(?:while|until|for)\b[^\n#]*+")),
        r"(?m)(?:^[\x20\t]*|=\s*)(?:if|unless|case|begin)(?![\w?!:])|(?<![\w.:@])do(?![\w?!:])", r"(?<![\w.:@])end(?![\w?!:])", r"(?<![\w.:@])(?:elsif|when|rescue)(?![\w?!:])|(?<=\S\x20)(?:if|unless|while|until)(?![\w?!:])|&&|\|\|",
    ),
}
#: Where a token of a brace language can start: at a word, or at one of a few signs. Asked first, it spares all else at most places.
_STARTS = {language: rf"(?:(?<![{word}])(?=[{word}])|(?=[/\"'`{{}}&|?\n]))" for language, word in (("javascript", r"\w$"), ("java", r"\w$"), ("go", r"\w"))}
_KEPT = "struct<lines:int,step:int,kind:string,name:string,decides:int>"


def _token(language: str) -> tuple[str, object]:
    """A language's token expression, and what a token means: line ends in it, +1 or -1 for depth, kind and name of a declaration, decisions."""
    _, plain, declared, opening, closing, decision = LANGUAGES[language]
    bare = lambda p: p.replace("(?m)", "")
    grouped = lambda p: f"^(?:{bare(p)})$"
    every = "(?m)" + _STARTS.get(language, "") + "(?:" + "|".join(f"(?:{bare(p)})" for p in (*plain, *(p for _, p in declared), opening, closing, decision, r"\n")) + ")"

    none = F.lit(None).cast("string")

    def mark(lines: object, step: object, kind: Column = none, name: Column = none, decides: object = 0) -> Column:
        as_int = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
        return F.struct(as_int(lines).alias("lines"), as_int(step).alias("step"), kind.alias("kind"), name.alias("name"), as_int(decides).alias("decides")).cast(_KEPT)

    def meaning(t: Column) -> Column:
        # most tokens are line ends, braces, comments, strings and decisions, and need no more than that
        lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
        plain = F.when(t == "\n", mark(1, 0))
        plain = plain.when(t == "end", mark(0, -1)) if language == "ruby" else plain.when(t == "{", mark(0, 1)).when(t == "}", mark(0, -1))
        plain = plain.when(hides(t), mark(lines, 0))
        if language != "ruby":  # there a decision is never a declaration, which ends in a brace or an arrow
            plain = plain.when(t.rlike(grouped(decision)), mark(0, 0, decides=1))
        return declares(plain, t, lines)

    def hides(t: Column) -> Column:
        return t.rlike(r"(?s)^(?://|/\*|[\"'`]|#)") if language != "ruby" else t.rlike(r"(?s)^(?:#|[\"'])")

    def declares(found: Column, t: Column, lines: Column) -> Column:
        """The first declaration that fits counts; each is tried once, as what is said of it lies in its own branch."""
        decides = F.when(t.rlike(grouped(decision)), 1).otherwise(F.when(t.rlike(r"^[\x20\t=]*(?:if|unless|while|until|for)\b"), 1).otherwise(0)) if language == "ruby" else F.lit(0)
        for k, p in declared:
            whole = _unfenced(p)
            found = found.when(t.rlike(whole), mark(lines, 0 if k == "arrow" else 1, F.lit(k or None).cast("string"), F.regexp_extract(t, whole, 1) if k else none, decides))
        step = F.when(t.rlike(grouped(closing)), -1).when(t.rlike(_unfenced(opening)) & ~t.rlike(_unfenced(decision)) | t.rlike(r"^\s*=\s*(?:if|unless|case|begin)$"), 1).otherwise(0)
        return found.otherwise(mark(lines, step, decides=decides))

    return every, meaning


def _unfenced(p: str) -> str:
    """An expression for a whole token: what may not stand before one was looked at when it was cut out."""
    for fence in (r"(?<![\w$.])", r"(?<![\w.:@])", r"(?<!\w)", r"(?<![\w$])", r"(?<=\S\x20)", "(?m)"):
        p = p.replace(fence, "")
    return f"(?s)^(?:{p})$"


def tokens(df: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, pos, lines, step, kind, name and decides of the tokens that matter, of every text whose path's extension is known."""
    extension = F.lower(F.regexp_extract(key, r"\.([^./\\]+)$", 1))
    found = F.lit(None)
    for language, (extensions, *_) in LANGUAGES.items():
        every, meaning = _token(language)
        found = F.when(extension.isin(*extensions), F.transform(F.regexp_extract_all(text, F.lit(every), F.lit(0)), meaning)).otherwise(found)
    # what neither ends lines nor opens, closes, declares or decides is nothing
    own = df.select(key, F.filter(found, lambda t: (t["lines"] > 0) | (t["step"] != 0) | t["kind"].isNotNull() | (t["decides"] > 0)).alias("t"))
    # outer: for the other, Spark asks first for texts that have tokens, and reads every text twice
    return own.select(key, F.posexplode_outer("t").alias("pos", "t")).where("pos IS NOT NULL").select(key, "pos", "t.*")


def extents(df: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, kind (function, method, class or arrow), name, start, stop (lines, from 1) and complexity of every declaration.

    Files are dealt by key once, over as many tasks as a shuffle has; tokens and all windows are made where a file then lies.
    """
    whole = Window.partitionBy(key)
    in_file = whole.orderBy("pos")
    t = tokens(dealt(df.select(key, text), key).distinct(), key, text)
    t = t.withColumns({"line": F.sum("lines").over(in_file) - F.col("lines") + 1, "last": F.sum("lines").over(whole) + 1, "depth": F.sum("step").over(in_file), "decided": F.sum("decides").over(in_file)})
    # an opening's level is the depth before it, a closing's the depth after it; arrows without braces have none
    t = t.where("step <> 0 OR kind IS NOT NULL").withColumn("level", F.when(F.col("step") != 0, F.col("depth") - F.greatest("step", F.lit(0))))
    next_there = lambda c: F.lead(c).over(Window.partitionBy(key, "level").orderBy("pos"))
    ends = F.when((F.col("step") != 0) & (next_there("step") == -1), F.struct(next_there("line").alias("line"), next_there("decided").alias("decided")))
    t = t.withColumns({"end": ends, "all_decided": F.max(F.when(F.col("step") != 0, F.col("decided"))).over(whole)}).where("step >= 0 AND kind IS NOT NULL")
    braced = F.col("step") > 0
    stop = F.when(braced, F.coalesce("end.line", "last")).otherwise(F.col("line"))
    complexity = F.when(braced, 1 + F.coalesce("end.decided", "all_decided") - F.col("decided")).otherwise(1)
    return t.select(key, "kind", "name", F.col("line").cast("int").alias("start"), stop.cast("int").alias("stop"), complexity.cast("int").alias("complexity"))


#: A planted file of each language, and its declarations: kind, name, first and last line, complexity.
PLANTED = (
    ("js", "// function no() {\nexport default class Box extends Base {\n  constructor(a, b = f(1)) { this.s = '}'; }\n  async size(n) {\n    if (n > 0 && this.ok) {\n      return `{${n}`;\n    }\n    /* } */\n  }\n}\nfunction run(x) { while (x) { x--; } }\nconst add = (a, b) => a + b;\nconst twice = async (f) => {\n  for (const g of [f, f]) { g({}); }\n};",
     (("class", "Box", 2, 10, 3), ("method", "constructor", 3, 3, 1), ("method", "size", 4, 9, 3), ("function", "run", 11, 11, 2), ("arrow", "add", 12, 12, 1), ("function", "twice", 13, 15, 2))),
    ("java", "package a;\npublic class Shop<T> {\n  private String s = \"class X { \\\" {\";\n  public Shop(int n) {\n    this.r = new Runnable() {\n      public void run() { if (a || b) { c(); } }\n    };\n  }\n  static List<String> all(Map<K, V> m) throws A, B\n  {\n    for (K k : m.keySet()) { switch (k) { case 1: break; } }\n    return null; // }\n  }\n}\ninterface Port { void open(); }",
     (("class", "Shop", 2, 14, 5), ("method", "Shop", 4, 8, 3), ("method", "run", 6, 6, 3), ("method", "all", 9, 13, 3), ("class", "Port", 15, 15, 1))),
    ("go", "package a\n\ntype Box struct {\n\tn int // {\n}\n\nfunc (b *Box) Size(k string) (map[string]interface{}, error) {\n\tif k == \"}\" || b == nil {\n\t\treturn nil, nil\n\t}\n\tf := func(x int) int { return x }\n\treturn nil, f(1)\n}\nfunc Max[T any](a, b T) T {\n\treturn `{\n{`\n}",
     (("class", "Box", 3, 5, 1), ("function", "Size", 7, 13, 3), ("function", "Max", 14, 17, 1))),
    ("rb", "module Shop\n  class Box\n    def size(n)\n      return 0 if n == 0\n      while n > 1 do\n        n -= 1 # end\n      end\n      x = if n then 1 else 'end' end\n      items.each do |i|\n        puts \"def no\"\n      end\n    end\n    def self.empty?\n      true && @end\n    end\n  end\nend",
     (("class", "Shop", 1, 17, 5), ("class", "Box", 2, 16, 5), ("function", "size", 3, 12, 4), ("function", "empty?", 13, 15, 2))),
)


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files made from the parts, in turn of each language, behind size modulo 3 empty lines."""
    k = F.col("p_partkey")
    of = lambda i: F.element_at(F.array(*(F.lit(p[i]) for p in PLANTED)), (k % len(PLANTED)).cast("int") + 1)
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(F.concat(F.lit("src/p"), k.cast("string"), F.lit("."), of(0)).alias("path"), F.concat(F.repeat(F.lit("\n"), (F.col("p_size") % 3).cast("int")), of(1)).alias("text"))


@query("txt14_extents", f"SELECT 'src/p' || p_partkey || '.' || e.extension AS path, e.kind, e.name, cast(e.start + p_size % 3 as int) AS start, cast(e.stop + p_size % 3 as int) AS stop, e.complexity FROM part JOIN (VALUES " + ", ".join(f"({i}, '{x}', '{kind}', '{name}', {a}, {b}, {c})" for i, (x, _, found) in enumerate(PLANTED) for kind, name, a, b, c in found) + f") e(k, extension, kind, name, start, stop, complexity) ON e.k = p_partkey % {len(PLANTED)}")
def txt14_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extents(planted(spark, sf_dir))


@query("scl38_brace_complexity", "SELECT p_partkey % 4 AS language, max(complexity) AS most, count(*) AS n FROM part JOIN (VALUES " + ", ".join(f"({i}, {c})" for i, (_, _, found) in enumerate(PLANTED) for *_, c in found) + ") e(k, complexity) ON e.k = p_partkey % 4 GROUP BY 1")
def scl38_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexity of the declarations of every language."""
    found = extents(planted(spark, sf_dir))
    key = F.regexp_extract("path", r"p(\d+)\.", 1).cast("long") % 4
    return found.groupBy(key.alias("language")).agg(F.max("complexity").alias("most"), F.count("*").alias("n"))
