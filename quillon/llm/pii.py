"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Seeds are the matches of four fixed kinds (email, ip, card, phone) and strings in known forms of credentials (secret).
Every seed and every other token with a digit or an @ is an instance; what stands around an occurrence gives its lexical
patterns: the two words before it, the word before it with the instance's shape (digits as 0, letters as a, runs of both
as x and their length), and the shape with the word after it. Patterns and instances form a bipartite graph, scored in
rounds. A pattern's confidence in a kind is the mean of its distinct instances' beliefs: 1 for a seed of that kind, 0
for a seed of another, and for an unseen instance the largest confidence of the patterns trusted so far. A pattern is
trusted if its confidence is CONFIDENT and SUPPORT distinct instances of that belief stand in it, seeds or instances that
earlier rounds have found: so found instances make new patterns trusted, which find further ones. What stands in a
trusted pattern, other than seeds of the four fixed kinds, is a span of its kind; a secret is one only there.

Offsets are code points, ends exclusive. A match's offset comes from the lengths of the pieces that split() leaves
between the matches of the same expression. The expressions are the given ones with possessive repeats and look-behind
where a start inside a run cannot succeed if the run's start has failed; both accept the same spans, in linear time.

Cases: a null text is empty and has no spans; repeated rows get equal rows; ties in a pattern's kind go to the kind
listed first; texts of any length are read whole; an empty table gives no rows; extra columns are not read by detect()
and are kept by redact().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import written

KINDS = ("email", "ip", "card", "phone")
#: All kinds; the last has no spans of its own, only seeds.
FOUND = (*KINDS, "secret")
#: Credentials whose form alone tells them: hexadecimal keys, and the prefixes that some services give theirs.
SECRET = r"^(?:(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,128}|(?=[0-9]*[A-F])(?=[A-F]*[0-9])[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,})$"
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A token with a digit or an @ between white space; what may enclose it.
TOKEN, OPENING, CLOSING = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+", r"""^["'(\[<{]*""", r"""["')\]>}.,;:!?#$%&*]*$"""
#: Characters before and after a match in which its words are looked for.
BEFORE = 64
SUPPORT, CONFIDENT, ROUNDS = 3, 0.8, 3
_SPAN = "struct<start:bigint,no:int,kind:string,end:bigint,value:string>"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes: from the right, every second digit doubled, the sum a multiple of 10."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 1, value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)).otherwise(value(i))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda total, i: total + doubled(i)) % 10 == 0


def _accepted(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.lpad(part(p), 3, "0") <= "255"))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.when(F.length(digits) <= 19, _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _placed(text: Column, pattern: str, hits: Column) -> Column:
    """start and value of every hit, in order."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,value:string>>").alias("out"))

    def step(state: Column, pair: Column) -> Column:
        at = state["at"] + F.length(pair["gap"])
        here = F.array(F.struct(at.cast("bigint").alias("start"), pair["hit"].alias("value")))
        return F.struct((at + F.coalesce(F.length(pair["hit"]), F.lit(0))).cast("bigint").alias("at"), F.when(pair["hit"].isNull(), state["out"]).otherwise(F.concat(state["out"], here)).alias("out"))

    return F.when(F.size(hits) > 0, F.aggregate(pairs, start, step, lambda s: s["out"])).otherwise(F.array().cast("array<struct<start:bigint,value:string>>"))


def _shape(value: Column) -> Column:
    """A token with its characters' classes for its characters; long ones end in their length."""
    mixed = F.regexp_replace(value, r"(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[0-9A-Za-z]+", "x")
    plain = F.regexp_replace(F.regexp_replace(mixed, "[0-9]", "0"), r"(?!x)\p{L}+", "a")
    return F.concat(F.substring(plain, 1, 32), F.length(value).cast("string"))


def _contexts(before: Column, value: Column, after: Column) -> Column:
    """The patterns that an occurrence stands in; words are in lower case with digits as 0."""
    plain = lambda w: F.regexp_replace(F.regexp_replace(w, "[0-9]+", "0"), r"\s+", " ")
    low, shape = F.lower(before), _shape(value)
    two = F.regexp_extract(low, r"(?<!\S)(\S+\s+\S+)\s+[\"'(\[<{]*$", 1)
    one = F.regexp_extract(low, r"(?<!\S)(\S+)\s+[\"'(\[<{]*$", 1)
    following = F.regexp_extract(F.lower(after), r"^\S*\s+(\S+)(?=\s|$)", 1)
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    coarse = F.when((digits < 4) & ~value.contains("@"), "few").otherwise("")
    every = F.array(F.when(two != "", F.concat(F.lit("l|"), coarse, F.lit("|"), plain(two))), F.when(one != "", F.concat(F.lit("s|"), shape, F.lit("|"), plain(one))), F.when(following != "", F.concat(F.lit("r|"), shape, F.lit("|"), plain(following))))
    return F.filter(every, lambda c: c.isNotNull())


def scanned(df: DataFrame, text: str = "text", contexts: bool = True) -> DataFrame:
    """df with base (spans of the fixed kinds, by start, then kind) and, if asked for, seen (contexts, instance, kind or null, start, end of seeds and other tokens)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__t", whole)
    t = F.col("__t")
    may = {"email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]"), "phone": t.contains("+")}
    none = F.array().cast("array<string>")
    kinds = (*KINDS, *(["token"] if contexts else []))
    df = df.withColumns({f"__h_{k}": F.when(may[k], F.regexp_extract_all(t, F.lit(PATTERNS[k]), 0)).otherwise(none) for k in KINDS} | ({"__h_token": F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(TOKEN), 0)).otherwise(none)} if contexts else {}))
    df = df.withColumns({f"__p_{k}": _placed(t, PATTERNS.get(k, TOKEN), F.col(f"__h_{k}")) for k in kinds})
    spans = []
    for no, kind in enumerate(KINDS):
        good = F.filter(F.col(f"__p_{kind}"), lambda s: _accepted(kind, s["value"]))  # noqa: B023 - called at once
        spans.append(F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("no"), F.lit(kind).alias("kind"), (s["start"] + F.length(s["value"])).alias("end"), s["value"].alias("value")).cast(_SPAN)))  # noqa: B023
    df = df.withColumn("base", F.array_sort(F.concat(*spans)))
    if not contexts:
        return df.drop("__t", *(f"__{a}_{k}" for a in "hp" for k in kinds))

    def trimmed(s: Column) -> Column:
        core = F.regexp_replace(s["value"], OPENING, "")
        start = s["start"] + F.length(s["value"]) - F.length(core)
        core = F.regexp_replace(core, CLOSING, "")
        kind = F.when((F.length(core) >= 20) & core.rlike(SECRET), F.lit("secret"))
        return F.struct(start.cast("bigint").alias("start"), F.lit(-1).alias("no"), kind.alias("kind"), (start + F.length(core)).cast("bigint").alias("end"), core.alias("value")).cast(_SPAN)

    free = lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])) & s["value"].rlike("[0-9@]")
    df = df.withColumn("__other", F.filter(F.transform(F.col("__p_token"), trimmed), free))
    before = lambda s: F.substring(t, F.greatest(s["start"] - BEFORE, F.lit(0)).cast("int") + 1, F.least(s["start"], F.lit(BEFORE)).cast("int"))
    after = lambda s: F.substring(t, s["end"].cast("int") + 1, F.lit(BEFORE))
    seen = F.transform(F.concat(F.col("base"), F.col("__other")), lambda s: F.struct(_contexts(before(s), s["value"], after(s)).alias("contexts"), F.xxhash64(F.lower(s["value"])).alias("instance"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    df = df.withColumn("seen", F.filter(seen, lambda s: F.size(s["contexts"]) > 0))
    return df.drop("__t", "__other", *(f"__{a}_{k}" for a in "hp" for k in kinds))


def learn(seen: DataFrame, support: int = SUPPORT, confident: float = CONFIDENT, rounds: int = ROUNDS) -> DataFrame:
    """context, found (kind) and confidence of the trusted patterns. seen: context, instance, kind (null for what is no seed), a row for each occurrence."""
    edges = seen.groupBy("context", "instance").agg(F.max("kind").alias("kind"))  # partial counts first: hot contexts shrink before the shuffle
    known = edges.groupBy("context").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("context")
    edges = written(edges.join(known, "context", "left_semi"), "pii-edges")
    seeds = {k: F.when(F.col("kind") == k, 1.0).otherwise(0.0) for k in FOUND}
    trusted, before = None, None
    for _ in range(rounds):
        if trusted is None:
            joined, belief = edges, seeds
        else:  # what the trusted patterns say of unseen instances
            unseen = edges.where("kind IS NULL").join(trusted, "context").groupBy("instance").agg(*(F.max(F.when(F.col("found") == k, F.col("confidence")).otherwise(0.0)).alias(f"i_{k}") for k in FOUND))
            joined = edges.join(unseen, "instance", "left")
            belief = {k: F.when(F.col("kind").isNull(), F.coalesce(F.col(f"i_{k}"), F.lit(0.0))).otherwise(seeds[k]) for k in FOUND}
        scores = joined.groupBy("context").agg(*(F.avg(belief[k]).alias(f"c_{k}") for k in FOUND), *(F.count_if(belief[k] >= confident).alias(f"n_{k}") for k in FOUND))
        found = None
        for k in FOUND:
            good = (F.col(f"c_{k}") >= confident) & (F.col(f"n_{k}") >= support)
            found = F.when(good, F.struct(F.lit(k).alias("found"), F.col(f"c_{k}").alias("confidence"))) if found is None else found.when(good, F.struct(F.lit(k).alias("found"), F.col(f"c_{k}").alias("confidence")))
        trusted = written(scores.select("context", found.alias("f")).where("f IS NOT NULL").select("context", "f.*"), "pii-patterns")
        state = tuple(trusted.agg(F.count("*"), F.sum(F.xxhash64("context", "found", "confidence").cast("decimal(20,0)"))).first())
        if state == before:  # further rounds would say the same
            break
        before = state
    return trusted


def _uid(text: str, more: list[str]) -> list[Column]:
    """Two 64-bit hashes that name a row, or equal rows."""
    parts = [*(F.col(c) for c in more), F.coalesce(F.col(text), F.lit(""))]
    return [F.xxhash64(*parts).alias("uid"), F.xxhash64(F.lit(1), *parts).alias("uid2")]


def _stage(docs: DataFrame, text: str, more: list[str]) -> DataFrame:
    """Base spans and occurrences of every row, without the text; uid and uid2 are equal for equal rows."""
    return written(scanned(docs.select(*more, text, *_uid(text, more)), text).drop(text), "pii-scan")


def _extra(stage: DataFrame) -> DataFrame:
    """uid, uid2 and extra: the spans that trusted patterns add, each of its most trusted pattern's kind."""
    seen = stage.select("uid", "uid2", F.explode("seen").alias("s")).select("uid", "uid2", "s.*").withColumn("context", F.explode("contexts")).drop("contexts")
    patterns = learn(seen.select("context", "instance", "kind"))
    no = F.array_position(F.array(*(F.lit(k) for k in FOUND)), F.col("found")) - 1
    places = seen.where("kind IS NULL OR kind = 'secret'").join(patterns.withColumn("no", no.cast("int")), "context")
    best = places.groupBy("uid", "uid2", "start", "end").agg(F.max_by(F.struct("no", "found"), F.struct("confidence", -F.col("no"))).alias("b"))
    span = F.struct(F.col("start"), F.col("b.no").alias("no"), F.col("b.found").alias("kind"), F.col("end"), F.lit("").alias("value")).cast(_SPAN)
    return best.groupBy("uid", "uid2").agg(F.collect_list(span).alias("extra"))


def _is(kind: str) -> object:
    return lambda s: s["kind"] == kind


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans and n_spans (all of them) of every row."""
    stage = _stage(docs, text, ["doc_id"])
    joined = stage.join(_extra(stage), ["uid", "uid2"], "left")
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    every = F.array_sort(F.concat("base", F.coalesce(F.col("extra"), F.array().cast(f"array<{_SPAN}>"))))
    return joined.withColumn("every", every).select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("every")).alias("spans"), F.size("every").cast("long").alias("n_spans"))


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; overlapping spans are one, named by the first. A column n_chars follows the text."""
    extra = written(_extra(_stage(docs, text, [key])), "pii-extra")  # small, so that joining it needs no shuffle of the texts
    named = docs.withColumn("__row", F.struct(*(c for c in docs.columns if c != text))).select(*_uid(text, [key]), F.col(text).alias("__text"), "__row")  # apart from columns of clashing names
    joined = scanned(named, "__text", False).join(extra, ["uid", "uid2"], "left")
    none = F.array().cast(f"array<{_SPAN}>")
    every = F.array_sort(F.concat(F.coalesce("base", none), F.coalesce("extra", none)))
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<a:bigint,b:bigint,kind:string>>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        inside = s["start"] < state["at"]
        last = F.element_at(state["out"], -1)
        grown = F.concat(F.slice(state["out"], 1, F.size(state["out"]) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["end"]).alias("b"), last["kind"].alias("kind"))))
        added = F.concat(state["out"], F.array(F.struct(s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("kind"))))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(inside, grown).otherwise(added).alias("out"))

    joined = joined.withColumn("__cuts", F.aggregate(every, empty, step, lambda s: s["out"]))
    cuts, t = F.col("__cuts"), F.col("__text")
    place = lambda c, i: F.concat(F.substring(t, F.when(i == 0, F.lit(0)).otherwise(F.get(cuts, i - 1)["b"]).cast("int") + 1, (c["a"] - F.when(i == 0, F.lit(0)).otherwise(F.get(cuts, i - 1)["b"])).cast("int")), F.lit("<"), F.upper(c["kind"]), F.lit(">"))
    tail = F.substring(t, F.element_at(cuts, -1)["b"].cast("int") + 1, F.lit(2147483647))
    masked = F.when(F.size(cuts) > 0, F.concat(F.array_join(F.transform(cuts, place), ""), tail)).otherwise(t)
    types = dict(docs.dtypes)
    own = {text: F.col("__masked"), "n_chars": F.when(F.size("__cuts") > 0, F.length("__masked")).otherwise(F.col("__row.n_chars")).cast(types["n_chars"])} if "n_chars" in types else {text: F.col("__masked")}
    return joined.withColumn("__masked", masked).select(*(own.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns))
