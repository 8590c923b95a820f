"""Dashboards: trends, tops, coverage, velocity, debt, scores, breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.operators.ranges import running
from quillon.plans.fixtures import EFFORT, SEVERITIES, WEIGHT, agent_runs, as_of, findings, pick, scans, severity_counts, sla_records, sql_pick

LOW = [s.lower() for s in WEIGHT]
SQL_SUMS = ", ".join(f"cast(sum({s}) as bigint) AS {s}" for s in ("total", *LOW))
#: Letters of a score and of a debt (upper limits), labels of a posture.
RATINGS = ((90, "A"), (80, "B"), (70, "C"), (60, "D"), (50, "E"))
DEBTS = ((10, "A", "low"), (30, "B", "low"), (60, "C", "medium"), (100, "D", "high"), (200, "E", "high"))
POSTURES = ((85, "Excellent"), (70, "Good"), (55, "Fair"), (40, "Poor"))


def sums() -> list[Column]:
    return [F.sum(s).alias(s) for s in ("total", *LOW)]


def ladder(value: Column, steps: tuple[tuple[float, str], ...], last: str) -> Column:
    """The label of the first step that the value reaches."""
    out = None
    for least, label in steps:
        out = F.when(value >= least, label) if out is None else out.when(value >= least, label)
    return out.otherwise(last)


def sql_ladder(value: str, steps: tuple[tuple[float, str], ...], last: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {x} THEN '{label}'" for x, label in steps) + f" ELSE '{last}' END"


def week_label(day: Column) -> Column:
    """Year and Monday-based week of the year, week 0 before the first Monday."""
    week = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7)
    return F.concat(F.year(day).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def severity_weight() -> Column:
    return pick(WEIGHT, F.col("severity"), 0)


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans(findings(spark, sf_dir))


@query("agg03_store_stats", f"SELECT count(*) AS scans, {SQL_SUMS}, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM scans")
def agg03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir).agg(F.count("*").alias("scans"), *sums(), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))


@query("agg04_trend_day", f"SELECT strftime(end_time, '%Y-%m-%d') AS bucket, {SQL_SUMS} FROM scans WHERE end_time >= TIMESTAMP '2001-09-01' - INTERVAL 365 DAY GROUP BY 1")
def agg04_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = _scans(spark, sf_dir).where(F.col("end_time") >= as_of() - F.expr("INTERVAL 365 DAYS"))
    return recent.groupBy(F.date_format("end_time", "yyyy-MM-dd").alias("bucket")).agg(*sums())


@query("agg04_trend_week", f"SELECT strftime(end_time, '%Y-W%W') AS bucket, {SQL_SUMS} FROM scans GROUP BY 1")
def agg04_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir).groupBy(week_label(F.col("end_time")).alias("bucket")).agg(*sums())


@query("agg04_trend_long", "SELECT strftime(end_time, '%Y-%m') AS bucket, severity, cast(sum(n) as bigint) AS n FROM scans UNPIVOT (n FOR severity IN (critical, high, medium, low, info)) GROUP BY 1, 2")
def agg04_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _scans(spark, sf_dir).unpivot(["end_time"], LOW, "severity", "n")
    return long.groupBy(F.date_format("end_time", "yyyy-MM").alias("bucket"), "severity").agg(F.sum("n").alias("n"))


@query("agg05_risk_trend", "SELECT name, scan_id, end_time, raw_score, row_number() OVER (PARTITION BY name ORDER BY end_time, scan_id) AS point FROM scans WHERE end_time >= TIMESTAMP '2001-09-01' - INTERVAL 730 DAY")
def agg05(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = _scans(spark, sf_dir).where(F.col("end_time") >= as_of() - F.expr("INTERVAL 730 DAYS"))
    return recent.select("name", "scan_id", "end_time", "raw_score", F.row_number().over(Window.partitionBy("name").orderBy("end_time", "scan_id")).cast("long").alias("point"))


def trend_direction(points: DataFrame, by: str, order: tuple[str, ...], value: str) -> DataFrame:
    """by and direction: the mean of the last third against the first, 10 % either way; down is improving."""
    w = Window.partitionBy(by).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(by))
    ranked = points.select(by, F.col(value).cast("double").alias("v"), (F.row_number().over(w) - 1).alias("i"), n.alias("n"))
    sums = ranked.groupBy(by).agg(F.max("n").alias("n"), F.avg(F.when(F.col("i") < F.floor(F.col("n") / 3), F.col("v"))).alias("early"), F.avg(F.when(F.col("i") >= F.floor(2 * F.col("n") / 3), F.col("v"))).alias("late"))
    change = F.try_divide(F.col("late") - F.col("early"), F.col("early")) * 100
    return sums.select(by, F.when((F.col("n") < 3) | (F.col("early") == 0), "stable").when(change < -10, "improving").when(change > 10, "declining").otherwise("stable").alias("direction"))


@query("agg06_trend_direction", """WITH r AS (SELECT name, cast(total as double) AS v, row_number() OVER (PARTITION BY name ORDER BY end_time, scan_id) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM scans),
s AS (SELECT name, max(n) AS n, avg(v) FILTER (i < n // 3) AS early, avg(v) FILTER (i >= 2 * n // 3) AS late FROM r GROUP BY name)
SELECT name, CASE WHEN n < 3 OR early = 0 THEN 'stable' WHEN (late-early)/early*100 < -10 THEN 'improving' WHEN (late-early)/early*100 > 10 THEN 'declining' ELSE 'stable' END AS direction FROM s""")
def agg06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend_direction(_scans(spark, sf_dir), "name", ("end_time", "scan_id"), "total")


def change_percentage(first: Column, last: Column, n: Column) -> Column:
    return F.when(n < 2, 0.0).when(first == 0, F.when(last > 0, 100.0).otherwise(0.0)).otherwise(F.try_divide(last - first, first) * 100)


@query("agg07_change_pct", """SELECT name, round_even(CASE WHEN n < 2 THEN 0 WHEN f = 0 THEN CASE WHEN l > 0 THEN 100 ELSE 0 END ELSE (l - f) / f * 100 END, 4) AS change_pct FROM
(SELECT name, count(*) AS n, cast(arg_min(total, (end_time, scan_id)) as double) AS f, cast(arg_max(total, (end_time, scan_id)) as double) AS l FROM scans GROUP BY name)""")
def agg07(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("end_time", "scan_id")
    ends = _scans(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n"), F.min_by("total", at).cast("double").alias("f"), F.max_by("total", at).cast("double").alias("l"))
    return ends.select("name", F.bround(change_percentage(F.col("f"), F.col("l"), F.col("n")), 4).alias("change_pct"))


@query("agg08_top_files", f"""SELECT file_path, count(*) AS n, cast(sum({sql_pick(WEIGHT, 'severity')}) as bigint) AS score, {', '.join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in WEIGHT)}, count(DISTINCT category) AS categories, arg_min(scan_id, id) AS first_scan
FROM findings GROUP BY 1 ORDER BY score DESC, file_path LIMIT 20""")
def agg08(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = findings(spark, sf_dir).groupBy("file_path").agg(F.count("*").alias("n"), F.sum(severity_weight()).cast("long").alias("score"), *severity_counts(), F.count_distinct("category").alias("categories"), F.min_by("scan_id", "id").alias("first_scan"))
    return files.orderBy(F.desc("score"), "file_path").limit(20)


@query("agg09_top_repos", f"SELECT name, count(*) AS scans, {SQL_SUMS}, cast(sum(raw_score) as bigint) AS score FROM scans GROUP BY name ORDER BY score DESC, name LIMIT 10")
def agg09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir).groupBy("name").agg(F.count("*").alias("scans"), *sums(), F.sum("raw_score").alias("score")).orderBy(F.desc("score"), "name").limit(10)


@query("agg10_top_categories", f"SELECT category, count(*) AS n, {', '.join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in WEIGHT)} FROM findings GROUP BY 1 ORDER BY n DESC, category LIMIT 10")
def agg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), *severity_counts()).orderBy(F.desc("n"), "category").limit(10)


@query("agg11_coverage", "SELECT tool_source AS tool, count(DISTINCT scan_id) AS scans, count(*) AS findings, count(DISTINCT file_path) AS files, round_even(count(*) / count(DISTINCT scan_id), 1) AS per_scan FROM findings GROUP BY 1")
def agg11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy(F.col("tool_source").alias("tool")).agg(F.count_distinct("scan_id").alias("scans"), F.count("*").alias("findings"), F.count_distinct("file_path").alias("files"), F.bround(F.count("*") / F.count_distinct("scan_id"), 1).alias("per_scan"))


@query("agg12_velocity", """SELECT bucket, severity, count(*) AS remediated, round_even(avg(time_to_remediate_hours), 2) AS mttr_hours FROM
(SELECT strftime(detected_at + to_hours(cast(time_to_remediate_hours as int)), '%Y-W%W') AS bucket, severity, time_to_remediate_hours FROM sla_records WHERE status = 'remediated') GROUP BY GROUPING SETS ((bucket), (bucket, severity), (severity), ())""")
def agg12(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sla_records(findings(spark, sf_dir)).where("status = 'remediated'")
    at = F.col("detected_at") + F.make_dt_interval(F.lit(0), F.col("time_to_remediate_hours").cast("int"))
    rows = done.select(week_label(at).alias("bucket"), "severity", "time_to_remediate_hours")
    sets = rows.groupingSets([("bucket",), ("bucket", "severity"), ("severity",), ()], "bucket", "severity")
    return sets.agg(F.count("*").alias("remediated"), F.bround(F.avg("time_to_remediate_hours"), 2).alias("mttr_hours")).select("bucket", "severity", "remediated", "mttr_hours")


@query("agg13_debt", f"SELECT s.severity, count(f.id) AS n, cast(count(f.id) * s.weight as bigint) AS debt, count(f.id) * s.effort AS effort_hours FROM (VALUES {', '.join(f"('{s}', {w}, {e}::double)" for s, w, _, _, e in SEVERITIES)}) s(severity, weight, effort) LEFT JOIN findings f ON f.severity = s.severity GROUP BY s.severity, s.weight, s.effort")
def agg13(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = spark.createDataFrame([(s, w, e) for s, w, _, _, e in SEVERITIES], "severity string, weight long, effort double")
    counts = findings(spark, sf_dir).groupBy("severity").count()
    n = F.coalesce("count", F.lit(0))
    return dims.join(counts, "severity", "left").select("severity", n.alias("n"), (n * F.col("weight")).alias("debt"), (n * F.col("effort")).alias("effort_hours"))


def debt_rating(found: DataFrame) -> DataFrame:
    """Debt score, rating, risk and days of effort of each file and category."""
    per = found.groupBy(F.concat_ws(":", "file_path", "category").alias("name")).agg(F.sum(severity_weight()).cast("long").alias("score"), F.sum(pick(EFFORT, F.col("severity"), 1.0)).alias("hours"))
    rating, risk = F.when(F.col("score") == 0, "A+"), F.when(F.col("score") == 0, "low")
    for most, letter, label in DEBTS:
        rating, risk = rating.when(F.col("score") < most, letter), risk.when(F.col("score") < most, label)
    return per.select("name", "score", rating.otherwise("F").alias("rating"), risk.otherwise("critical").alias("risk"), F.bround(F.col("hours") / 8, 1).alias("days"))


@query("agg13_debt_rating_all", f"SELECT name, score, CASE WHEN score = 0 THEN 'A+' " + " ".join(f"WHEN score < {x} THEN '{a}'" for x, a, _ in DEBTS) + " ELSE 'F' END AS rating, CASE WHEN score = 0 THEN 'low' " + " ".join(f"WHEN score < {x} THEN '{b}'" for x, _, b in DEBTS) + f" ELSE 'critical' END AS risk, round_even(hours / 8, 1) AS days FROM (SELECT file_path || ':' || category AS name, cast(sum({sql_pick(WEIGHT, 'severity')}) as bigint) AS score, sum({sql_pick(EFFORT, 'severity')}::double) AS hours FROM findings GROUP BY 1)")
def agg13_rating_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debt_rating(findings(spark, sf_dir))


def security_score(found: DataFrame, by: str = "repo") -> DataFrame:
    """Composite score of density, severities, time to remediate and coverage for each value of by."""
    s = scans(found).groupBy(F.col("name").alias(by)).agg(F.count("*").alias("scans"), F.sum("total").alias("total"), F.sum("total_lines").alias("lines"), F.sum("critical").alias("critical"), F.sum("high").alias("high"))
    days = sla_records(found.withColumn("scan_id", F.col(by))).where("status = 'remediated'").groupBy(F.col("scan_id").alias(by)).agg((F.avg("time_to_remediate_hours") / 24).alias("days"))
    density = F.greatest(F.lit(0.0), 100 - F.try_divide(F.col("total"), F.col("lines")) * 1000 * 5)
    severity = F.greatest(F.lit(0.0), 100 - F.col("critical") / F.col("total") * 80 - F.col("high") / F.col("total") * 30)
    mttr = F.when(F.col("days").isNull(), 50.0).when(F.col("days") <= 7, 100.0).when(F.col("days") >= 90, 0.0).otherwise(100 - (F.col("days") - 7) / 83 * 100)
    coverage = F.least(F.lit(100), 15 + F.col("scans") * 2)
    overall = density * 0.3 + severity * 0.25 + mttr * 0.25 + coverage * 0.2
    return s.join(days, by, "left").select(by, F.bround(overall, 1).alias("score"), ladder(overall, RATINGS, "F").alias("rating"), ladder(overall, POSTURES, "Critical").alias("posture"))


@query("agg14_security_score", f"""WITH s AS (SELECT name AS repo, count(*) AS scans, sum(total) AS total, sum(total_lines) AS lines, sum(critical) AS critical, sum(high) AS high FROM scans GROUP BY 1),
d AS (SELECT repo, avg(l_quantity*12.0)/24 AS days FROM findings WHERE l_linestatus = 'F' GROUP BY 1),
o AS (SELECT repo, greatest(0, 100 - total/lines*1000*5)*0.3 + greatest(0, 100 - critical/total*80 - high/total*30)*0.25 + (CASE WHEN days IS NULL THEN 50 WHEN days <= 7 THEN 100 WHEN days >= 90 THEN 0 ELSE 100-(days-7)/83*100 END)*0.25 + least(100, 15+scans*2)*0.2 AS v FROM s LEFT JOIN d USING (repo))
SELECT repo, round_even(v, 1) AS score, {sql_ladder('v', RATINGS, 'F')} AS rating, {sql_ladder('v', POSTURES, 'Critical')} AS posture FROM o""")
def agg14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security_score(findings(spark, sf_dir))


@query("agg18_executive", "SELECT count(*) AS scans, cast(sum(total) as bigint) AS findings, round_even(avg(least(100, raw_score)), 1) AS avg_risk, max(least(100, raw_score)) AS max_risk, count(*) FILTER (end_time >= TIMESTAMP '2001-09-01' - INTERVAL 90 DAY) AS recent, count(DISTINCT name) AS repos FROM scans")
def agg18(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk = F.least(F.lit(100).cast("long"), "raw_score")
    return _scans(spark, sf_dir).agg(F.count("*").alias("scans"), F.sum("total").alias("findings"), F.bround(F.avg(risk), 1).alias("avg_risk"), F.max(risk).alias("max_risk"), F.count_if(F.col("end_time") >= as_of() - F.expr("INTERVAL 90 DAYS")).alias("recent"), F.count_distinct("name").alias("repos"))


@query("agg19_activity", "SELECT strftime(end_time, '%Y-%m-%d') AS day, count(*) AS scans, cast(sum(total) as bigint) AS findings FROM scans GROUP BY 1")
def agg19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir).groupBy(F.date_format("end_time", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("scans"), F.sum("total").alias("findings"))


@query("agg20_quick_trend", """WITH r AS (SELECT name, total, raw_score, row_number() OVER (PARTITION BY name ORDER BY end_time, scan_id) AS i, count(*) OVER (PARTITION BY name) AS n FROM scans),
h AS (SELECT name, max(n) AS n, avg(total) FILTER (i <= n // 2) AS a, avg(total) FILTER (i > n // 2) AS b, avg(raw_score) FILTER (i <= n // 2) AS c, avg(raw_score) FILTER (i > n // 2) AS d FROM r GROUP BY name)
SELECT name, CASE WHEN n < 4 THEN 'stable' WHEN (b-a)/greatest(a,1)*100 < -10 THEN 'improving' WHEN (b-a)/greatest(a,1)*100 > 10 THEN 'declining' ELSE 'stable' END AS overall, CASE WHEN n < 4 THEN 'stable' WHEN d - c < -5 THEN 'improving' WHEN d - c > 5 THEN 'declining' ELSE 'stable' END AS risk FROM h""")
def agg20(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("name")
    r = _scans(spark, sf_dir).select("name", "total", "raw_score", F.row_number().over(w.orderBy("end_time", "scan_id")).alias("i"), F.count("*").over(w).alias("n"))
    first = F.col("i") <= F.floor(F.col("n") / 2)
    h = r.groupBy("name").agg(F.max("n").alias("n"), F.avg(F.when(first, F.col("total"))).alias("a"), F.avg(F.when(~first, F.col("total"))).alias("b"), F.avg(F.when(first, F.col("raw_score"))).alias("c"), F.avg(F.when(~first, F.col("raw_score"))).alias("d"))
    change, risk = (F.col("b") - F.col("a")) / F.greatest("a", F.lit(1.0)) * 100, F.col("d") - F.col("c")
    say = lambda v, least: F.when(F.col("n") < 4, "stable").when(v < -least, "improving").when(v > least, "declining").otherwise("stable")
    return h.select("name", say(change, 10).alias("overall"), say(risk, 5).alias("risk"))


@query("agg21_benchmark", "SELECT scan_id, round_even(total / total_lines * 1000, 4) AS density, CASE WHEN total / total_lines * 1000 <= 2.5 THEN 'better' ELSE 'worse' END AS against FROM scans")
def agg21(spark: SparkSession, sf_dir: str) -> DataFrame:
    density = F.col("total") / F.col("total_lines") * 1000
    return _scans(spark, sf_dir).select("scan_id", F.bround(density, 4).alias("density"), F.when(density <= 2.5, "better").otherwise("worse").alias("against"))


@query("agg25_crossref", """WITH g AS (SELECT file_path, line_number, category, count(DISTINCT tool_source) AS n, array_to_string(list_sort(list(DISTINCT tool_source)), ',') AS sources, max(CASE confidence WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS best, arg_max(id, (CASE confidence WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END, -hash_ord)) AS primary_id FROM (SELECT *, row_number() OVER (ORDER BY id) AS hash_ord FROM findings) GROUP BY 1, 2, 3)
SELECT file_path, line_number, category, n, sources, best, (n - 1) * 20 AS boost, primary_id FROM g WHERE n > 1""")
def agg25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that several tools report: sources, best confidence, boost, and the finding that stands for the group."""
    level = pick({"HIGH": 3, "MEDIUM": 2}, F.col("confidence"), 1)
    g = findings(spark, sf_dir).groupBy("file_path", "line_number", "category").agg(F.sort_array(F.collect_set("tool_source")).alias("s"), F.max(level).alias("best"), F.min_by("id", F.struct(-level, "id")).alias("primary_id"))
    n = F.size("s").cast("long")
    return g.select("file_path", "line_number", "category", n.alias("n"), F.array_join("s", ",").alias("sources"), "best", ((n - 1) * 20).alias("boost"), "primary_id").where("n > 1")


@query("agg26_by_agent", "SELECT tool_source, count(*) AS n, round_even(avg(CASE confidence WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 0.5 ELSE 0.25 END), 6) AS avg_confidence, count(DISTINCT category) AS categories FROM findings GROUP BY 1")
def agg26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy("tool_source").agg(F.count("*").alias("n"), F.bround(F.avg(pick({"HIGH": 1.0, "MEDIUM": 0.5}, F.col("confidence"), 0.25)), 6).alias("avg_confidence"), F.count_distinct("category").alias("categories"))


@query("agg26_by_severity_category", "SELECT severity, category, count(*) AS n, grouping(severity) AS g1, grouping(category) AS g2 FROM findings GROUP BY CUBE (severity, category)")
def agg26_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).cube("severity", "category").agg(F.count("*").alias("n"), F.grouping("severity").cast("long").alias("g1"), F.grouping("category").cast("long").alias("g2"))


@query("agg27_remediation_plan", f"SELECT id, scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY {sql_pick({s: r for s, _, r, *_ in SEVERITIES}, 'severity')} DESC, id) AS priority, sum({sql_pick({'CRITICAL': 4, 'HIGH': 24, 'MEDIUM': 72, 'LOW': 168, 'INFO': 336}, 'severity')}) OVER (PARTITION BY scan_id)::bigint AS eta_hours FROM findings")
def agg27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities and hours to plan, for each scan."""
    w = Window.partitionBy("scan_id")
    rank = pick({s: r for s, _, r, *_ in SEVERITIES}, F.col("severity"))
    eta = pick({"CRITICAL": 4, "HIGH": 24, "MEDIUM": 72, "LOW": 168, "INFO": 336}, F.col("severity"))
    return findings(spark, sf_dir).select("id", "scan_id", F.row_number().over(w.orderBy(rank.desc(), "id")).cast("long").alias("priority"), F.sum(eta).over(w).alias("eta_hours"))


@query("agg28_chained", "SELECT file_path, line_number, category, count(DISTINCT tool_source) AS agents FROM findings GROUP BY 1,2,3 HAVING count(DISTINCT tool_source) >= 2 ORDER BY agents DESC, file_path, line_number, category LIMIT 50")
def agg28(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = findings(spark, sf_dir).groupBy("file_path", "line_number", "category").agg(F.count_distinct("tool_source").alias("agents")).where("agents >= 2")
    return g.orderBy(F.desc("agents"), "file_path", "line_number", "category").limit(50)


@query("agg29_chains", """WITH c AS (SELECT repo, file_path, count(*) AS nodes, count(DISTINCT tool_source) AS agents, sum(CASE confidence WHEN 'HIGH' THEN 90 WHEN 'MEDIUM' THEN 60 ELSE 30 END * CASE tool_source WHEN 'taint_analyzer' THEN 15 WHEN 'dast_scanner' THEN 12 ELSE 10 END) AS a, sum(CASE tool_source WHEN 'taint_analyzer' THEN 15 WHEN 'dast_scanner' THEN 12 ELSE 10 END) AS b, bool_or(tool_source = 'dast_scanner') AS dast FROM findings GROUP BY 1, 2)
SELECT repo, file_path, nodes, agents, round_even(least(100, a / b * CASE WHEN agents >= 3 THEN 1.15::double WHEN agents >= 2 THEN 1.08::double ELSE 1 END), 4) AS confidence, CASE WHEN dast AND agents > 1 THEN 'exploitable' WHEN agents > 1 THEN 'confirmed' ELSE 'single' END AS status FROM c""")
def agg29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of findings of one file: weighted mean confidence, raised where agents agree."""
    weight, value = pick({"taint_analyzer": 15, "dast_scanner": 12}, F.col("tool_source"), 10), pick({"HIGH": 90, "MEDIUM": 60}, F.col("confidence"), 30)
    c = findings(spark, sf_dir).groupBy("repo", "file_path").agg(F.count("*").alias("nodes"), F.count_distinct("tool_source").alias("agents"), (F.sum(value * weight) / F.sum(weight)).alias("v"), F.bool_or(F.col("tool_source") == "dast_scanner").alias("dast"))
    factor = F.when(F.col("agents") >= 3, 1.15).when(F.col("agents") >= 2, 1.08).otherwise(1.0)
    status = F.when(F.col("dast") & (F.col("agents") > 1), "exploitable").when(F.col("agents") > 1, "confirmed").otherwise("single")
    return c.select("repo", "file_path", "nodes", "agents", F.bround(F.least(F.lit(100.0), F.col("v") * factor), 4).alias("confidence"), status.alias("status"))


@query("agg30_agent_metrics", "SELECT agent_name, count(*) AS runs, round_even(avg(duration_ms), 4) AS avg_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, cast(sum(findings_count) as bigint) AS findings, round_even(count(*) FILTER (findings_count < 20) / count(*), 4) AS low_rate FROM agent_runs GROUP BY 1")
def agg30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent_runs(findings(spark, sf_dir)).groupBy("agent_name").agg(F.count("*").alias("runs"), F.bround(F.avg("duration_ms"), 4).alias("avg_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"), F.sum("findings_count").alias("findings"), F.bround(F.count_if(F.col("findings_count") < 20) / F.count("*"), 4).alias("low_rate"))


@query("agg31_false_positive_rate", "SELECT lang AS agent, count(*) AS judged, count(*) FILTER (toxic = 1) AS false_positives, round_even(count(*) FILTER (toxic = 1) / count(*), 4) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def agg31(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    return judged.groupBy(F.col("lang").alias("agent")).agg(F.count("*").alias("judged"), F.count_if(F.col("toxic") == 1).alias("false_positives"), F.bround(F.count_if(F.col("toxic") == 1) / F.count("*"), 4).alias("rate"))


@query("agg32_agreement", "SELECT count(*) FILTER (a > 1) AS agreed, count(*) AS places, round_even(count(*) FILTER (a > 1) / count(*), 4) AS rate FROM (SELECT count(DISTINCT tool_source) AS a FROM findings GROUP BY scan_id, file_path, line_number)")
def agg32(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = findings(spark, sf_dir).groupBy("scan_id", "file_path", "line_number").agg(F.count_distinct("tool_source").alias("a"))
    return a.agg(F.count_if(F.col("a") > 1).alias("agreed"), F.count("*").alias("places"), F.bround(F.count_if(F.col("a") > 1) / F.count("*"), 4).alias("rate"))


@query("agg33_efficiency", "SELECT n > 5 AS multi, count(*) AS scans, round_even(avg(ms), 4) AS avg_ms FROM (SELECT scan_id, count(*) AS n, sum(duration_ms) AS ms FROM agent_runs GROUP BY 1) GROUP BY 1")
def agg33(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = agent_runs(findings(spark, sf_dir)).groupBy("scan_id").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("ms"))
    return per.groupBy((F.col("n") > 5).alias("multi")).agg(F.count("*").alias("scans"), F.bround(F.avg("ms"), 4).alias("avg_ms"))


@query("agg46_most_common", "SELECT tool_source, category, n FROM (SELECT tool_source, category, count(*) AS n, min(id) AS o FROM findings GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY tool_source ORDER BY n DESC, o) <= 3")
def agg46(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = findings(spark, sf_dir).groupBy("tool_source", "category").agg(F.count("*").alias("n"), F.min("id").alias("o"))
    return counts.withColumn("k", F.row_number().over(Window.partitionBy("tool_source").orderBy(F.desc("n"), "o"))).where("k <= 3").select("tool_source", "category", "n")


@query("agg22_repo_breakdown", "SELECT repo AS project, count(DISTINCT scan_id) AS scans, count(*) AS findings, greatest(0, least(100, 100 - cast(sum(" + sql_pick(WEIGHT, "severity") + ") as bigint))) AS score FROM findings GROUP BY 1")
def agg22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy(F.col("repo").alias("project")).agg(F.count_distinct("scan_id").alias("scans"), F.count("*").alias("findings"), F.greatest(F.lit(0).cast("long"), F.least(F.lit(100).cast("long"), 100 - F.sum(severity_weight()))).alias("score"))


@query("win06_last_ten", """WITH r AS (SELECT name, end_time, raw_score, row_number() OVER (PARTITION BY name ORDER BY end_time DESC, scan_id DESC) AS k FROM scans)
SELECT name, arg_max(raw_score, k) AS first_score, arg_min(raw_score, k) AS last_score, count(*) AS n FROM r WHERE k <= 10 GROUP BY name""")
def win06(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("end_time"), F.desc("scan_id")))
    last = _scans(spark, sf_dir).select("name", "raw_score", k.alias("k")).where("k <= 10")
    return last.groupBy("name").agg(F.max_by("raw_score", "k").alias("first_score"), F.min_by("raw_score", "k").alias("last_score"), F.count("*").alias("n"))


@query("win08_running_mean", "SELECT agent_name, scan_id, round_even(avg(duration_ms) OVER (PARTITION BY agent_name ORDER BY scan_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM agent_runs")
def win08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = running(agent_runs(findings(spark, sf_dir)).select("agent_name", "scan_id", "duration_ms"), "agent_name", ["scan_id"], sums=("duration_ms",))
    return rows.select("agent_name", "scan_id", F.bround(F.col("sum_duration_ms") / F.col("row_no"), 4).alias("running"))


@query("win09_last_runs", "SELECT agent_name, scan_id, duration_ms FROM agent_runs QUALIFY row_number() OVER (PARTITION BY agent_name ORDER BY scan_id DESC) <= 100")
def win09(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("agent_name").orderBy(F.desc("scan_id")))
    return agent_runs(findings(spark, sf_dir)).withColumn("k", k).where("k <= 100").select("agent_name", "scan_id", "duration_ms")
