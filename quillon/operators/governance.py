"""Text governance: redaction of personal data and secrets, prompt-injection and bias scores, the governed call's decision."""

from __future__ import annotations

import bisect
import re
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.catalog import query
from quillon.sources.tables import table

# Kinds of personal data and secrets with their patterns, in order of precedence.
REDACTIONS = (
    ("AWS_SECRET_KEY", r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+=]{40}(?![A-Za-z0-9/+=])"),
    ("AWS_ACCESS_KEY", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("PRIVATE_KEY", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    ("GITHUB_TOKEN", r"\bgh[posru]_[A-Za-z0-9]{20,}\b"),
    ("SLACK_TOKEN", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    ("OPENAI_KEY", r"\bsk-[A-Za-z0-9]{20,}\b"),
    ("JWT", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("CREDIT_CARD", r"\b(?:\d[ -]*?){13,16}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("IPV4", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"),
    ("PHONE", r"\b(?:\+?\d{1,3}[ -]?)?(?:\(?\d{3}\)?[ -]?)\d{3}[ -]?\d{4}\b"),
)
#: Fixed value: a setting whose value is a secret.
KEY_VALUE = r"(?i)\b(password|passwd|pwd|secret|token|api[_-]?key|authorization|bearer)\b\s*[:=]\s*['\"]?([^\s'\"&]{4,})['\"]?"
#: What a match cannot do without: one of these strings, for kinds that have them.
_HOLDS = {"AWS_ACCESS_KEY": ("AKIA", "ASIA"), "PRIVATE_KEY": ("-----BEGIN ",), "GITHUB_TOKEN": ("gho_", "ghp_", "ghr_", "ghs_", "ghu_"), "SLACK_TOKEN": ("xox",), "OPENAI_KEY": ("sk-",), "JWT": ("eyJ",)}
#: Matches of the kinds made of digits lie whole in such stretches; the shortest has 7 characters.
_DIGITS, _OF_DIGITS = re.compile(r"[+(]?\d[\d ().+-]{6,}"), ("CREDIT_CARD", "SSN", "IPV4", "PHONE")
#: Addresses consist of these characters.
_OF_ADDRESSES, _ADDRESS_END = frozenset(string.ascii_letters + string.digits + "._%+@-"), re.compile(r"[A-Za-z0-9._%+@-]*")
#: A setting's value follows one of these signs, and its name, of at most 13 characters and one of these last ones, stands before it.
_SIGN, _NAME, _LAST = re.compile("[:=]"), re.compile(KEY_VALUE[: KEY_VALUE.index(r"\b\s*")].replace(r"\b", "", 1) + r"\Z"), frozenset("dtnyrDTNYR")
_COMPILED, _SETTING = {kind: re.compile(p) for kind, p in REDACTIONS}, re.compile(KEY_VALUE)
# Weight, label and pattern of signals in a prompt and in an output.
INJECTION = (
    (3, "ignore_previous_instructions", r"(?i)ignore\s+(?:all\s+)?(?:the\s+)?(?:previous|prior|above)\s+(?:instructions|prompts?|rules)"),
    (3, "disregard_instructions", r"(?i)disregard\s+(?:all\s+)?(?:previous|prior|the)\s+"),
    (3, "reveal_system_prompt", r"(?i)(?:reveal|show|print|repeat|leak)\s+(?:your|the)\s+(?:system\s+)?(?:prompt|instructions)"),
    (3, "developer_mode", r"(?i)(?:developer|dev|god|sudo|admin)\s+mode"),
    (3, "jailbreak", r"(?i)\b(?:jailbreak|dan\s+mode|do\s+anything\s+now)\b"),
    (2, "act_as_unfiltered", r"(?i)you\s+are\s+(?:now\s+)?(?:an?\s+)?(?:unfiltered|uncensored|unrestricted)"),
    (2, "pretend_no_rules", r"(?i)pretend\s+(?:you\s+have\s+)?no\s+(?:rules|restrictions|guidelines)"),
    (2, "override_safety", r"(?i)(?:bypass|override|disable|turn\s+off)\s+(?:your\s+)?(?:safety|guardrails|filters|moderation)"),
    (2, "new_instructions", r"(?i)(?:new|updated)\s+(?:system\s+)?instructions\s*:"),
    (1, "role_switch", r"(?i)from\s+now\s+on\s+you\s+(?:are|will)"),
    (1, "exfiltrate", r"(?i)(?:send|post|exfiltrate|upload)\s+(?:the\s+)?(?:data|secrets|credentials)\s+to"),
)
OUTPUT = (
    (3, "leaked_system_prompt", r"(?i)my\s+(?:system\s+)?(?:prompt|instructions)\s+(?:are|is|say)"),
    (2, "confirms_jailbreak", r"(?i)(?:sure|ok|okay)[,!.]?\s+(?:i\s+(?:will|can)\s+)?ignore"),
    (2, "unrestricted_persona", r"(?i)as\s+an?\s+(?:unfiltered|uncensored|unrestricted|dan)"),
)
# Groups of people; category, severity and pattern of biased text.
GROUPS = r"men|women|males?|females?|whites?|blacks?|asians?|hispanics?|latinos?|jews?|muslims?|christians?|immigrants?|foreigners?|gays?|lesbians?|old\s+people|young\s+people|the\s+elderly|teenagers?"
BIAS = (
    ("generalization", "medium", rf"(?i)\b(?:all|every|most|typical)\s+(?:{GROUPS})\s+(?:are|can'?t|cannot|never|always)\b"),
    ("inferiority_superiority", "high", rf"(?i)\b(?:{GROUPS})\s+are\s+(?:inferior|superior|less\s+intelligent|smarter|dumber|worse|better)\b"),
    ("toxic_language", "high", r"(?i)\b(?:idiot|stupid|moron|worthless|disgusting|hate\s+you|kill\s+yourself)\b"),
    ("exclusionary", "medium", rf"(?i)\b(?:{GROUPS})\s+(?:should\s+not|shouldn'?t|don'?t\s+belong|aren'?t\s+welcome)\b"),
    ("stereotype_role", "low", r"(?i)\b(?:women\s+belong\s+in|men\s+should\s+be|a\s+real\s+man)\b"),
)


def luhn(text: str) -> bool:
    """Whether 13 to 19 digits pass the checksum."""
    digits = [int(c) for c in text if c.isdigit()]
    if not 13 <= len(digits) <= 19:
        return False
    return sum(d if (len(digits) - i) % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def _addresses(text: str) -> list[tuple[int, int]]:
    """Start and end of the stretches around every @ that addresses lie in."""
    out, at, last = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _OF_ADDRESSES:
            start -= 1
        last = _ADDRESS_END.match(text, at).end()
        out.append((start, last))
        at = text.find("@", last)
    return out


def _settings(text: str) -> list[tuple[int, int]]:
    """Start and end of the values of settings that are secrets, as KEY_VALUE finds them; it is tried where a name stands before a sign."""
    out, last = [], 0
    for sign in _SIGN.finditer(text):
        end = sign.start()
        while end and text[end - 1].isspace():
            end -= 1
        if end and text[end - 1] in _LAST and (name := _NAME.search(text, max(0, end - 13), end)) and name.start() >= last and (m := _SETTING.match(text, name.start())):
            out.append(m.span(2))
            last = m.end()
    return out


def _spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Kind, start and end of every match of every pattern, in order of the patterns. Each is tried only where a match can lie."""
    digits, whole = [m.span() for m in _DIGITS.finditer(text)], [(0, len(text))]
    for kind, pattern in _COMPILED.items():
        if kind in _OF_DIGITS:
            places = digits
        elif kind == "EMAIL":
            places = _addresses(text)
        elif kind == "AWS_SECRET_KEY":  # white space is no part of these 40 characters
            places = whole if max(map(len, text.split()), default=0) >= 40 else []
        else:
            places = whole if any(h in text for h in _HOLDS[kind]) else []
        for start, end in places:  # the character after a stretch tells whether a word ends there
            for m in pattern.finditer(text, start, min(end + 1, len(text))):
                if kind != "CREDIT_CARD" or luhn(m.group()):
                    yield kind, *m.span()
    yield from (("SECRET", *s) for s in _settings(text))


def redact_text(text: str | None, redact_ip: bool = True) -> tuple[str | None, list[tuple[str, str, int, int]], dict[str, str]]:
    """The redacted text, the spans (kind, placeholder, start, end) by start, and the mapping back."""
    if not text:
        return text, [], {}
    candidates = [c for c in _spans(text) if redact_ip or c[0] != "IPV4"]
    taken: list[tuple[int, int, str, str]] = []  # ascending and apart from each other
    counts: dict[str, int] = {}
    for kind, start, end in candidates:
        i = bisect.bisect(taken, (start, end))
        if (i and taken[i - 1][1] > start) or (i < len(taken) and taken[i][0] < end):
            continue
        counts[kind] = counts.get(kind, 0) + 1
        taken.insert(i, (start, end, kind, f"[REDACTED_{kind}_{counts[kind]}]"))
    out, at = [], 0
    for a, b, _, mark in taken:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]]), [(kind, mark, a, b) for a, b, kind, mark in taken], {mark: text[a:b] for a, b, _, mark in taken}


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """df with redaction: struct of the redacted text, its spans and the mapping back."""
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("placeholder", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))), T.StructField("mapping", T.MapType(T.StringType(), T.StringType()))])

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [redact_text(t) for t in texts]
        return pd.DataFrame({"text": [r[0] for r in rows], "spans": [[dict(zip(("kind", "placeholder", "start", "end"), s)) for s in r[1]] for r in rows], "mapping": [r[2] for r in rows]})

    return df.withColumn("redaction", run(text))


def rehydrated(text: Column, mapping: Column) -> Column:
    """The text with every placeholder replaced by what it stands for."""
    return F.aggregate(F.map_entries(mapping), text, lambda t, e: F.replace(t, e["key"], e["value"]))


def signal_score(text: Column, signals: tuple[tuple[int, str, str], ...] = INJECTION) -> Column:
    """Sum of the weights of the signals that a text has."""
    return sum((F.when(text.rlike(p), w).otherwise(0) for w, _, p in signals), F.lit(0))


def signal_labels(text: Column, signals: tuple[tuple[int, str, str], ...] = INJECTION) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), label) for _, label, p in signals)))


def risk_level(score: Column) -> Column:
    return F.when(score >= 3, "high").when(score >= 2, "medium").when(score > 0, "low").otherwise("none")


def bias_categories(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), c) for c, _, p in BIAS)))


def bias_severity(text: Column) -> Column:
    rank = F.greatest(*(F.when(text.rlike(p), {"low": 1, "medium": 2, "high": 3}[s]).otherwise(0) for _, s, p in BIAS))
    return F.element_at(F.array(*map(F.lit, ("none", "low", "medium", "high"))), rank + 1)


def decision(text: Column, model: Column, sensitivity: Column, allowed: tuple[str, ...]) -> Column:
    """The governed call's ladder: allow-list, sensitivity, injection, output screens."""
    return F.when(~model.isin(*allowed), "blocked_model").when(sensitivity == "restricted", "blocked_sensitivity").when(signal_score(text) >= 3, "blocked_injection").when(bias_severity(text).isin("medium", "high"), "flagged").otherwise("allowed")


def _hits(signals: tuple, column: str = "text", at: int = 2) -> list[str]:
    return [f"regexp_matches({column}, '{s[at].replace(chr(39), chr(39) * 2)}')" for s in signals]


_SCORE = " + ".join(f"CASE WHEN {h} THEN {s[0]} ELSE 0 END" for h, s in zip(_hits(INJECTION), INJECTION))
_BIAS = ", ".join(f"CASE WHEN {h} THEN '{s[0]}' END" for h, s in zip(_hits(BIAS), BIAS))
_BIAS_RANK = "greatest(" + ", ".join(f"CASE WHEN {h} THEN {dict(low=1, medium=2, high=3)[s[1]]} ELSE 0 END" for h, s in zip(_hits(BIAS), BIAS)) + ")"


@query("txt03_injection", f"SELECT conv_id, turn, s AS score, CASE WHEN s >= 3 THEN 'high' WHEN s >= 2 THEN 'medium' WHEN s > 0 THEN 'low' ELSE 'none' END AS level FROM (SELECT conv_id, turn, {_SCORE} AS s FROM conversations)")
def txt03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", signal_score(F.col("text")).alias("score")).withColumn("level", risk_level(F.col("score")))


@query("txt04_bias", f"SELECT doc_id, array_to_string(list_filter([{_BIAS}], lambda x: x IS NOT NULL), ',') AS categories, ['none','low','medium','high'][{_BIAS_RANK} + 1] AS severity FROM documents WHERE {_BIAS_RANK} > 0")
def txt04(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_join(bias_categories(F.col("text")), ",").alias("categories"), bias_severity(F.col("text")).alias("severity"))
    return d.where("severity <> 'none'")


@query("txt01_redact")
def txt01(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = redacted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.sha2(F.col("redaction.text"), 256).alias("redacted_sha256"), F.size("redaction.spans").alias("n_spans"))


@query("txt02_round_trip")
def txt02(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = redacted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", (rehydrated(F.col("redaction.text"), F.col("redaction.mapping")) == F.col("text")).alias("same"))


@query("agg43_pii_counts")
def agg43(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = redacted(table(spark, sf_dir, "documents").select("text"))
    return out.select(F.explode("redaction.spans").alias("s")).groupBy(F.col("s.kind").alias("kind")).agg(F.count("*").alias("n"))


_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query("txt01_email_count", f"SELECT lang, cast(sum(len(regexp_extract_all(text, '{_EMAIL}'))) as bigint) AS emails FROM documents GROUP BY 1")
def txt01_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(_EMAIL))).alias("emails"))


@query("txt17_governed", f"SELECT doc_id, CASE WHEN lang NOT IN ('en','de','fr') THEN 'blocked_model' WHEN source = 'src3' THEN 'blocked_sensitivity' WHEN {_SCORE} >= 3 THEN 'blocked_injection' WHEN {_BIAS_RANK} >= 2 THEN 'flagged' ELSE 'allowed' END AS decision FROM documents")
def txt17(spark: SparkSession, sf_dir: str) -> DataFrame:
    sensitivity = F.when(F.col("source") == "src3", "restricted").otherwise("public")
    return table(spark, sf_dir, "documents").select("doc_id", decision(F.col("text"), F.col("lang"), sensitivity, ("en", "de", "fr")).alias("decision"))


@query("txt13_predicates", "SELECT lang, count(*) FILTER (regexp_matches(lower(text), 'license|copyright')) AS licensed, count(*) FILTER (regexp_matches(text, 'token *[:=]')) AS tokens FROM documents GROUP BY 1")
def txt13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(F.lower("text").rlike("license|copyright")).alias("licensed"), F.count_if(F.col("text").rlike("token *[:=]")).alias("tokens"))


#: Words that make a setting a secret.
ENV_WORDS = ("password", "secret", "token", "api_key", "apikey", "private_key", "access_key", "auth", "credential", "database_url", "connection_string", "jwt", "encryption")


@query("txt07_env_lines", "SELECT doc_id, cast(pos as int) AS line_number, trim(substr(line, instr(line, '=') + 1)) AS value FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE NOT starts_with(trim(line), '#') AND instr(line, '=') > 0 AND regexp_matches(lower(line), '" + "|".join(ENV_WORDS) + "') AND length(trim(substr(line, instr(line, '=') + 1))) > 4")
def txt07(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    value = F.trim(F.expr("substr(line, instr(line, '=') + 1)"))
    hit = ~F.trim("line").startswith("#") & (F.instr("line", "=") > 0) & F.lower("line").rlike("|".join(ENV_WORDS)) & (F.length(value) > 4)
    return lines.where(hit).select("doc_id", (F.col("pos") + 1).alias("line_number"), value.alias("value"))


def entropy(text: Column) -> Column:
    """Shannon entropy over characters, in bits."""
    chars = F.split(text, "")
    n = F.length(text)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return -F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda total, c: total + F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))


@query("scl21_entropy_whole", "WITH c AS (SELECT item_id, unnest(string_split(text, '')) AS ch FROM benchmark), n AS (SELECT item_id, ch, count(*) AS k FROM c GROUP BY 1, 2), t AS (SELECT item_id, sum(k) AS s FROM n GROUP BY 1) SELECT n.item_id, round_even(-sum(k / s * log2(k / s)), 6) AS entropy FROM n JOIN t USING (item_id) GROUP BY 1")
def scl21_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.bround(entropy(F.col("text")), 6).alias("entropy"))
