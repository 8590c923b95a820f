"""Deduplication of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.plans.fixtures import RANK, findings, pick, scans, severity_counts, sql_pick
from quillon.sources.shared import kept

KEY = ("scan_id", "file_path", "line_number", "category")
#: Points of a representative by confidence and severity.
CONFIDENCE_POINTS = {"HIGH": 4, "MEDIUM": 2, "LOW": 0}
SEVERITY_POINTS = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 2, "LOW": 1, "INFO": 0}


def first_by(df: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    """The first row of each key in the order given."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def dedup(found: DataFrame, keys: tuple[str, ...] = KEY, order: str = "id") -> DataFrame:
    """One finding for each place and category: the worst severity, the first seen of equals.

    An aggregate that keeps the best row, so most rows go before the shuffle and nothing is sorted.
    """
    rest = [c for c in found.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct((-pick(RANK, F.col("severity"))).alias("rank"), F.col(order).alias("order")))
    return found.groupBy(*keys).agg(best.alias("b")).select(*(F.col(c) if c in keys else F.col(f"b.{c}") for c in found.columns))


def dedup_hash() -> Column:
    return F.md5(F.concat_ws(":", "file_path", F.col("line_number").cast("string"), "category"))


def best_points() -> Column:
    """How good a finding represents its group."""
    return pick(CONFIDENCE_POINTS, F.col("confidence"), 0) + pick(SEVERITY_POINTS, F.col("severity"), 0)


@query("dup01_dedup", "SELECT id, scan_id, file_path, line_number, category, severity, tool_source FROM deduped")
def dup01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(findings(spark, sf_dir)).select("id", *KEY, "severity", "tool_source")


@query("agg01_scan_stats", "SELECT scan_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (severity='{s}') AS {s.lower()}" for s in RANK) + " FROM deduped GROUP BY scan_id")
def agg01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(findings(spark, sf_dir)).groupBy("scan_id").agg(F.count("*").alias("total"), *severity_counts())


@query("agg02_scan_risk", "SELECT scan_id, raw_score, least(100, raw_score) AS risk_score FROM (SELECT scan_id, cast(sum(CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 4 WHEN 'LOW' THEN 1 ELSE 0 END) as bigint) AS raw_score FROM deduped GROUP BY scan_id) ORDER BY raw_score DESC, scan_id LIMIT 20")
def agg02(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scans(dedup(findings(spark, sf_dir))).select("scan_id", "raw_score", F.least(F.lit(100), "raw_score").cast("long").alias("risk_score"))
    return scored.orderBy(F.desc("raw_score"), "scan_id").limit(20)


@query("agg02_order_risk", "SELECT split_part(id,'-',1) AS scan_id, least(100, cast(sum(CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 4 WHEN 'LOW' THEN 1 ELSE 0 END) as bigint)) AS risk_score FROM findings GROUP BY 1")
def agg02_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans(findings(spark, sf_dir).withColumn("scan_id", F.split_part("id", F.lit("-"), F.lit(1)))).select("scan_id", F.least(F.lit(100).cast("long"), "raw_score").alias("risk_score"))


@query("dup02_hash_groups", "SELECT md5(concat_ws(':', file_path, cast(line_number as varchar), category)) AS dedup_hash, count(*) AS n, min(id) AS first_id FROM findings GROUP BY 1")
def dup02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy(dedup_hash().alias("dedup_hash")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("dup03_best", f"SELECT dedup_hash, id, points FROM (SELECT *, md5(concat_ws(':', file_path, cast(line_number as varchar), category)) AS dedup_hash, {sql_pick(CONFIDENCE_POINTS, 'confidence', 0)} + {sql_pick(SEVERITY_POINTS, 'severity', 0)} AS points FROM findings) QUALIFY row_number() OVER (PARTITION BY dedup_hash ORDER BY points DESC, id) = 1")
def dup03(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = findings(spark, sf_dir).select("id", dedup_hash().alias("dedup_hash"), best_points().alias("points"))
    return first_by(scored, ("dedup_hash",), F.desc("points"), F.col("id"))


@query("dup05_sources", "SELECT scan_id, md5(concat_ws(':', file_path, cast(line_number as varchar), category)) AS dedup_hash, array_to_string(list_sort(list(DISTINCT tool_source)), ',') AS sources, count(DISTINCT tool_source) AS n_sources FROM findings GROUP BY 1, 2 HAVING count(DISTINCT tool_source) > 1")
def dup05(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = findings(spark, sf_dir).groupBy("scan_id", dedup_hash().alias("dedup_hash")).agg(F.sort_array(F.collect_set("tool_source")).alias("s"))
    return grouped.where(F.size("s") > 1).select("scan_id", "dedup_hash", F.array_join("s", ",").alias("sources"), F.size("s").cast("long").alias("n_sources"))


def normalised(text: Column) -> Column:
    """Lower case, other characters than letters, digits and white space dropped, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", ""), r"\s+", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two texts' sets of tokens; 1 if both are empty."""
    x, y = F.array_remove(F.array_distinct(F.split(a, " ")), ""), F.array_remove(F.array_distinct(F.split(b, " ")), "")
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def semantic_similarity(a: Column, b: Column) -> Column:
    """0.6 of the token similarity and 0.4 of the edit similarity of two normalised texts."""
    longest = F.greatest(F.length(a), F.length(b))
    edit = F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)
    return 0.6 * jaccard(a, b) + 0.4 * edit


@query("dup04_semantic_pairs", """WITH t AS (SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS n FROM benchmark),
p AS (SELECT a.item_id AS a, b.item_id AS b, a.n AS x, b.n AS y, list_filter(list_distinct(string_split(a.n,' ')), lambda w: w<>'') AS s, list_filter(list_distinct(string_split(b.n,' ')), lambda w: w<>'') AS u FROM t a JOIN t b ON a.item_id < b.item_id),
q AS (SELECT a, b, 0.6::double * (len(list_intersect(s,u)) / len(list_distinct(list_concat(s,u)))) + 0.4::double * (1 - levenshtein(x,y) / greatest(length(x),length(y))) AS v FROM p)
SELECT a, b, round_even(v, 6) AS similarity FROM q WHERE v >= 0.15""")
def dup04_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of similar texts of a small table: those that share a token, and others whose lengths allow the edit similarity that they then need."""
    t = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", normalised(F.col("text")).alias("n"))
    tokens = t.select("item_id", F.explode(F.array_distinct(F.split("n", " "))).alias("w"))
    pairs = tokens.alias("a").join(tokens.alias("b"), F.expr("a.w = b.w AND a.item_id < b.item_id")).select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b")).distinct()
    s = t.withColumn("s", F.split("n", " "))
    apart = s.alias("a").join(s.alias("b"), F.expr("a.item_id < b.item_id AND NOT arrays_overlap(a.s, b.s) AND 8 * least(length(a.n), length(b.n)) >= 3 * greatest(length(a.n), length(b.n))"))
    pairs = pairs.unionByName(apart.select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b")))
    both = pairs.join(t.select(F.col("item_id").alias("a"), F.col("n").alias("x")), "a").join(t.select(F.col("item_id").alias("b"), F.col("n").alias("y")), "b")
    return both.withColumn("v", semantic_similarity(F.col("x"), F.col("y"))).where("v >= 0.15").select("a", "b", F.bround("v", 6).alias("similarity"))


#: Texts of at most SHORT tokens meet by three of their rarest tokens, longer ones by one.
SHORT = 24


def _near(nodes: DataFrame) -> DataFrame:
    """scan_id, x, y, xn and yn: pairs (x before y, by first) of different texts n that may be 0.85 similar, each pair once.

    Such texts share 3/4 of all their tokens and 5/8 of their lengths. Of two with s and t tokens at least o = 3/7 (s + t)
    are shared, so that m of the first s - o + m of one (the rarest of the scan come first) are among the first t - o + m
    of the other. Three tokens are seldom shared by texts that are not alike, where one, the name of a tool say, often is.
    """
    words = nodes.select("scan_id", "n", "first", F.explode(F.array_distinct(F.split("n", " "))).alias("w"))
    often = words.groupBy("scan_id", "w").agg(F.count("*").alias("often"))
    ranked = words.join(often, ["scan_id", "w"]).groupBy("scan_id", "n", "first").agg(F.array_sort(F.collect_list(F.struct("often", "w"))).alias("ws"))
    ranked = kept(ranked.select("scan_id", "n", "first", F.col("ws.w").alias("ws"), F.size("ws").alias("size")), "ranked")

    def meeting(some: DataFrame, m: Column, more: Column) -> DataFrame:
        a, b = some.alias("a"), some.alias("b")
        near = (F.col("a.scan_id") == F.col("b.scan_id")) & (F.col("a.w") == F.col("b.w")) & (F.col("a.first") < F.col("b.first")) & (8 * F.least(F.length("a.n"), F.length("b.n")) >= 5 * F.greatest(F.length("a.n"), F.length("b.n"))) & more
        # a pair meets at each choice of shared tokens, and is taken at the first one
        first = F.array_join(F.slice(F.array_intersect("a.p", "b.p"), F.lit(1), m), " ") == F.col("a.w")
        return a.hint("merge").join(b, near & first).select("a.scan_id", F.col("a.first").alias("x"), F.col("b.first").alias("y"), F.col("a.n").alias("xn"), F.col("b.n").alias("yn"))

    # short texts: once for each number of tokens that a similar one may have
    sized = ranked.where(F.col("size") <= SHORT).withColumn("of", F.explode(F.expr(f"sequence((3 * size + 3) div 4, least(4 * size div 3, {SHORT}))").cast("array<int>")))
    sized = sized.withColumn("o", F.expr("int((3 * (size + of) + 6) div 7)")).where("o <= least(size, of)").withColumn("p", F.slice("ws", F.lit(1), F.col("size") - F.col("o") + F.least(F.lit(3), "o")))
    threes = "IF(o < 3, array(array_join(p, ' ')), flatten(transform(sequence(1, size(p) - 2), i -> flatten(transform(sequence(i + 1, size(p) - 1), j -> transform(sequence(j + 1, size(p)), k -> concat_ws(' ', p[i - 1], p[j - 1], p[k - 1])))))))"
    sized = sized.select("scan_id", "n", "first", "size", "of", "p", F.explode(F.expr(threes)).alias("w"))
    short = meeting(sized, F.lit(3), (F.col("a.size") == F.col("b.of")) & (F.col("a.of") == F.col("b.size")))
    # with more than SHORT tokens on one side there are at least 3/4 as many on the other
    some = ranked.where(F.col("size") > SHORT * 3 // 4).withColumn("p", F.slice("ws", F.lit(1), F.floor(F.col("size") / 4).cast("int") + 1)).select("scan_id", "n", "first", "size", "p", F.explode("p").alias("w"))
    return short.unionByName(meeting(some, F.lit(1), (F.greatest("a.size", "b.size") > SHORT) & (4 * F.least("a.size", "b.size") >= 3 * F.greatest("a.size", "b.size"))))


def _alike(x: Column, y: Column, least: float) -> Column:
    """Whether two texts are so similar; the tokens are compared first, as they rule out most."""
    return (jaccard(x, y) >= (least - 0.4) / 0.6 - 1e-9) & (semantic_similarity(x, y) >= least)


def semantic_pairs(found: DataFrame, description: str = "description", least: float = 0.85) -> DataFrame:
    """scan_id, a, b and similarity of the pairs of different normalised descriptions of a scan that are at least so similar."""
    nodes = found.select("scan_id", F.trim(normalised(F.col(description))).alias("n")).where("n <> ''").distinct().withColumn("first", F.col("n"))
    scored = _near(nodes).where(_alike(F.col("xn"), F.col("yn"), least)).withColumn("v", semantic_similarity(F.col("xn"), F.col("yn")))
    return scored.select("scan_id", F.col("xn").alias("a"), F.col("yn").alias("b"), F.bround("v", 6).alias("similarity"))


def greedy_leads(pairs: DataFrame, group: str) -> DataFrame:
    """group, y and lead: what a greedy pass over the nodes in order would take, and the first leader that it takes them for.

    pairs: group, x and y (x before y in order) for each two nodes that are alike. In order, a node that no leader before it
    is like leads. All is decided in rounds: a node without an earlier neighbour that is still open leads, and takes its
    later neighbours; what is decided leaves the pairs. So a group of any size is spread over all tasks. The number of
    rounds is that of leaders along the longest chain of decisions: few for groups of likes, many for a long path.
    """
    every = live = kept(pairs.select(group, "x", "y").distinct(), "greedy")
    taken = None
    while not live.isEmpty():
        leads = live.select(group, "x").distinct().join(live.select(group, F.col("y").alias("x")).distinct(), [group, "x"], "left_anti")
        new = kept(live.join(leads, [group, "x"], "left_semi").select(group, "y").distinct(), "greedy")
        live = kept(live.join(leads, [group, "x"], "left_anti").join(new, [group, "y"], "left_anti").join(new.select(group, F.col("y").alias("x")), [group, "x"], "left_anti").select(group, "x", "y"), "greedy")
        taken = new if taken is None else taken.unionByName(new)
    if taken is None:
        return every.select(group, "y", F.col("x").alias("lead"))
    # what was never taken leads
    return every.join(taken.select(group, F.col("y").alias("x")), [group, "x"], "left_anti").groupBy(group, "y").agg(F.min("x").alias("lead"))


def _edges_by_text(real: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """scan_id, x and y as by _edges_by_scan: each two different texts are compared once, whatever the number of scans they are in."""
    alike = _near(texts.select(F.lit("").alias("scan_id"), "n", F.col("n").alias("first"))).where(_alike(F.col("xn"), F.col("yn"), least))
    # texts are known by number from here on, as each stands in many scans
    alike = kept(alike.select(F.col("xn").alias("n"), F.col("yn").alias("m")).join(texts, "n").join(texts.select(F.col("n").alias("m"), F.col("t").alias("u")), "m").select("t", "u"), "alike")
    alike = alike.unionByName(alike.select(F.col("u").alias("t"), F.col("t").alias("u")))
    numbered = kept(real.join(texts, "n").select("scan_id", "t", "k"), "numbered")
    wanted = numbered.join(alike, "t").select("scan_id", F.col("k").alias("x"), F.col("u").alias("t"))
    return wanted.join(numbered.withColumnRenamed("k", "y"), ["scan_id", "t"]).where("x < y").select("scan_id", "x", "y")


def _edges_by_scan(real: DataFrame, least: float) -> DataFrame:
    """scan_id, x and y: numbers of the nodes of a scan whose texts are at least so similar, x < y."""
    return _near(real.withColumnRenamed("k", "first")).where(_alike(F.col("xn"), F.col("yn"), least)).select("scan_id", "x", "y")


def semantic_groups(found: DataFrame, description: str = "description", order: str = "id", least: float = 0.85, points: Column | None = None) -> DataFrame:
    """scan_id, id, lead and kept of every finding: greedy groups of similar descriptions within a scan.

    In order, a finding that is in no group leads one and takes every later one that is in none and similar to it; the best
    of a group (by points) is kept, the first of equals. Equal descriptions are one node. Where texts stand in many scans
    they are compared once for all of them, otherwise scan by scan; both give all similar pairs.
    """
    if least < 0.85:
        raise ValueError("the block of tokens is exact for similarities of at least 0.85 only")
    rows = found.select("scan_id", "id", F.col(order).alias("o"), (best_points() if points is None else points).alias("points"), F.coalesce(normalised(F.col(description)), F.lit("")).alias("n"))
    # texts without tokens are like no other, not even an equal one; written once, as found may be a long way to go
    rows = kept(rows.withColumn("n", F.trim("n")).withColumn("alone", F.when(F.col("n") == "", F.col("id"))), "rows")
    nodes = rows.groupBy("scan_id", "n", "alone").agg(F.min(F.struct("o", "id")).alias("first"))
    # k: numbers in the order of the nodes, as partitions are in order after the sort
    nodes = kept(nodes.orderBy("first").select("scan_id", "n", "alone", F.col("first.id").alias("first"), F.monotonically_increasing_id().alias("k")), "nodes")
    real = nodes.where("alone IS NULL").select("scan_id", "n", "k")
    texts = kept(real.select("n").distinct().withColumn("t", F.monotonically_increasing_id()), "texts")
    n_nodes, n_scans = real.agg(F.count("*"), F.count_distinct("scan_id")).first()
    # pairs of texts, against pairs within scans of equal size
    edges = _edges_by_text(real, texts, least) if texts.count() ** 2 * n_scans <= n_nodes**2 else _edges_by_scan(real, least)
    taken = greedy_leads(edges, "scan_id").select("scan_id", F.col("y").alias("k"), "lead").join(nodes.select("scan_id", F.col("k").alias("lead"), F.col("first").alias("leader")), ["scan_id", "lead"]).drop("lead")
    led = nodes.join(taken, ["scan_id", "k"], "left").select("scan_id", "n", "alone", F.coalesce("leader", "first").alias("lead"))
    both = rows.alias("r").join(led.alias("l"), (F.col("r.scan_id") == F.col("l.scan_id")) & (F.col("r.n") == F.col("l.n")) & F.col("r.alone").eqNullSafe(F.col("l.alone"))).select("r.*", "lead")
    place = F.row_number().over(Window.partitionBy("scan_id", "lead").orderBy(F.desc("points"), "o", "id"))
    return both.select("scan_id", "id", "lead", (place == 1).alias("kept"))


def best_of_places(found: DataFrame) -> DataFrame:
    """scan_id, id, points, category, tool_source and file_path of the best finding of each dedup_hash() of a scan, the first of equals.

    Aggregates over short rows: first by the hash's parts, which are shuffled instead of it, then by the hash, as different
    parts may make the same text.
    """
    parts = ("scan_id", "file_path", "line_number", "category")
    best = found.groupBy(*parts).agg(F.min(F.struct((-best_points()).alias("less"), "id", "tool_source")).alias("b"))
    best = best.groupBy("scan_id", dedup_hash().alias("h")).agg(F.min(F.struct("b.less", "b.id", "b.tool_source", "category", "file_path")).alias("b"))
    return best.select("scan_id", "b.id", (-F.col("b.less")).alias("points"), "b.category", "b.tool_source", "b.file_path")


@query("dup04_semantic_groups")
def dup04_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the small table's scans, one for each place and category, by descriptions made from their place and category."""
    best = best_of_places(findings(spark, sf_dir))
    described = best.withColumn("description", F.concat_ws(" ", F.lit("possible"), "category", F.lit("found by"), "tool_source", F.lit("in"), F.replace(F.col("file_path"), F.lit("_"), F.lit(" "))))
    return semantic_groups(described, points=F.col("points"))


@query("set06_jaccard", """WITH t AS (SELECT item_id, string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')),' ') AS s FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.s,b.s)) AS common, len(list_distinct(list_concat(a.s,b.s))) AS either FROM t a JOIN t b ON b.item_id = a.item_id + 1""")
def set06(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.split(normalised(F.col("text")), " ").alias("s"))
    pairs = t.alias("a").join(t.alias("b"), F.expr("b.item_id = a.item_id + 1"))
    return pairs.select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), F.size(F.array_intersect("a.s", "b.s")).cast("long").alias("common"), F.size(F.array_union("a.s", "b.s")).cast("long").alias("either"))
