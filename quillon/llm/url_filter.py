"""URL filter: longest rule of host and path, else logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from a small labelled URL table (at most MOST_LABELLED rows are read, those of least
hash if there are more) and is one
weight vector of fixed size, sent to the tasks. Scoring looks n-grams up for a whole Arrow batch at once.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and gets the verdict of the model's
prior (allow, unless the labelled table is all blocked); repeated urls get equal verdicts; an empty table gives
no rows; extra columns are kept, but for those named host, path, rule, verdict or url_score, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: What pages of the default labelled table are about, by common kinds; none is taken from a corpus.
BAD = tuple(
    """
    casinos slots poker betting sportsbets roulette bingo lotto jackpots blackjack wagering bookmakers
    viagra cialis steroids dietpills noprescription painkillers slimming botox testosterone
    porn xxxvideos webcamgirls escorts nudes hookups adultsonly adultchat adultvideos adultdating sexcams hotgirls singles
    paydayloans instantcredit cryptodoubler quickmoney giveaways prizes replicawatches giftcards cashprizes freemoney binaryoptions getrich millionaire
    warez keygens cracks torrents serials phishing malware spyware ransomware cheats hacks trainers
    adserver adsnetwork adclicks tracking trackers popups pixeltracker bulkmail spammers linkfarms backlinks clickbait cheaptraffic seoboost followers
    cheapjerseys fakebags knockoffs luckyspin scratchcards miracle weightloss hairloss psychic horoscopes coupons vouchers
    """.split()
)
GOOD = tuple(
    """
    library council university school museum archive ministry waterworks court parliament college kindergarten embassy
    encyclopedia journal atlas dictionary algebra astronomy chemistry geography history biology physics linguistics geology botany
    news gazette weather radio football economics magazine reporter broadcasting stations
    python linux compiler database standards manuals tutorials wiki docs engineering networking robotics
    recipes garden timetables mountains music poetry films birds bicycles knitting chess theatre travel health cooking painting sailing hiking
    hospital charity orchestra choir parish railway airport harbour fisheries forestry beekeeping pottery woodwork
    translation education conservation heritage volunteers research institute laboratory observatory planetarium
    """.split()
)
#: Words beside the subjects: those of both kinds of hosts, and those of one kind (blocked first).
BESIDE = ("online", "my", "the", "daily", "city", "all", "first", "north")
OWN = (("free", "best", "cheap", "win", "hot", "super", "247", "4u"), ("society", "centre", "project", "guide", "national", "county", "open", "public"))
#: Paths of both kinds of pages, and of one kind (blocked first).
PATHS = ("/index.html", "/list", "/about", "/a/17", "/en/4711", "/de/80.html", "/fr/12/", "/es/356", "/", "/search", "/item/9.html", "/p/2024/05")
OWN_PATHS = (
    ("/bonus/claim-now", "/join-free", "/buy-now/cheap", "/click/out", "/win/signup", "/offer/limited", "/go/affiliate", "/download/setup.exe", "/live-cams/hot", "/promo/deal", "/play/jackpot", "/order/discreet"),
    ("/articles/history.html", "/docs/manual/index.html", "/events/calendar", "/catalogue/collection", "/research/papers", "/opening-hours", "/teaching/lectures", "/reports/annual", "/members/minutes", "/guide/chapter", "/exhibitions/current", "/contact/staff"),
)
#: Hosts of a subject.
FORMS = 24
MOST_LABELLED, BITS, SIZES = 10_000, 18, (3, 4, 5)
#: Log odds of block before anything is known of a url; share of the labelled rows in which an n-gram is too common to tell.
PRIOR, COMMON = -1.25, 0.1


def default_labelled() -> list[tuple[str, int]]:
    """The small labelled URL table: every subject in FORMS hosts, alone and with words beside it; 1 is blocked.

    Of a subject's hosts two in three have a word of its own kind and the others none or one that both kinds share; every
    second path is of its own kind.
    """
    tops, subs = ("com", "net", "org", "info"), ("", "www.", "m.", "blog.")
    out = []
    for y, subjects in ((1, BAD), (0, GOOD)):
        kind = 1 - y
        for i, subject in enumerate(subjects):
            for j in range(FORMS):
                words = BESIDE if j % 3 == 1 else OWN[kind]
                word = words[(i + j // 3) % len(words)]
                host = (f"{word}-{subject}", f"{subject}-{word}", f"{word}{subject}", f"{subject}{word}", subject if j % 3 == 1 else f"{word}-{subject}")[j // 3 % 5]
                paths = OWN_PATHS[kind] if j % 2 else PATHS
                out.append((f"https://{subs[(i + j) % 4]}{host}.example.{tops[(i + j // 4) % 4]}{paths[(i + 5 * j) % len(paths)]}", y))
    return out


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def grams(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hashed feature of every n-gram; hosts and paths have features of their own."""
    rows, features = [], []
    for seed, strings in ((1, hosts), (2, paths)):
        raw = [b"\x02" + (x or "").encode("utf-8", "replace") + b"\x03" for x in strings]
        lengths = np.array([len(x) for x in raw])
        flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(raw)), lengths)
        for n in SIZES:
            if len(flat) < n:
                continue
            h = np.full(len(flat) - n + 1, seed * 1_000_003 + n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) ^ flat[k : len(flat) - n + 1 + k]
            inside = owner[: len(h)] == owner[n - 1 :]
            h = h[inside]
            h ^= h >> np.uint64(29)
            rows.append(owner[: len(inside)][inside])
            features.append((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(features)) if rows else (np.zeros(0, np.int64),) * 2


def scores(hosts: Sequence[str], paths: Sequence[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of block."""
    rows, features = grams(hosts, paths)
    counts = np.maximum(np.bincount(rows, minlength=len(hosts)), 1)
    return 1 / (1 + np.exp(-(bias + np.bincount(rows, weights[features], minlength=len(hosts)) / np.sqrt(counts))))


def train(hosts: Sequence[str], paths: Sequence[str], labels: Sequence[int], rounds: int = 300, rate: float = 40.0, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent; both classes weigh the same.

    The bias is the prior and is not learnt, and n-grams that most rows have say nothing: a url without any n-gram that
    tells is judged by the prior.
    """
    rows, features = grams(hosts, paths)
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return np.zeros(1 << BITS), (4.0 if len(y) and y[0] else -4.0)
    norm = np.sqrt(np.maximum(np.bincount(rows, minlength=len(y)), 1))
    used, at = np.unique(features, return_inverse=True)
    having = np.bincount(np.unique(at * len(y) + rows) // len(y), minlength=len(used))
    tells = having <= max(1, COMMON * len(y))
    w = np.zeros(len(used))
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(PRIOR + np.bincount(rows, w[at], minlength=len(y)) / norm)))
        w -= rate * (np.bincount(at, ((p - y) * each / norm)[rows]) + l2 * w) * tells
    out = np.zeros(1 << BITS)
    out[used] = w
    return out, PRIOR


def filter_urls(df: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """df with host, path, rule, verdict and url_score (the model's probability of block).

    rules: verdict, host and path of each; few enough for one expression. labelled: columns url and label (1 is blocked).
    """
    if labelled is None:
        labelled = df.sparkSession.createDataFrame(default_labelled(), "url string, label int")
    sample = labelled.where(F.col("label").isNotNull()).select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label", "url").orderBy(F.xxhash64("url"), "url", "label").limit(MOST_LABELLED).drop("url").collect()
    weights, bias = train(*zip(*sample)) if sample else train([], [], [])
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict", "url_score")]
    source = df.select(*kept, host_of(df[url]).alias("host"), path_of(df[url]).alias("path"))
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("url_score", T.DoubleType())])
    packed = weights.astype(np.float32)
    nonzero = np.flatnonzero(packed)
    model = df.sparkSession.sparkContext.broadcast((nonzero, packed[nonzero], bias))  # at most 2^18 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, b = model.value
        w = np.zeros(1 << BITS)
        w[at] = values
        for batch in batches:
            p = scores(batch.column("host").to_pylist(), batch.column("path").to_pylist(), w, b)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, "url_score"])

    scored = source.mapInArrow(run, schema)
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [(v, h + p, ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)) for v, h, p in ordered]
    rule = verdict = None
    for v, name, fit in fits:
        rule = F.when(fit, name) if rule is None else rule.when(fit, name)
        verdict = F.when(fit, v) if verdict is None else verdict.when(fit, v)
    model_says = F.when(F.col("url_score") >= threshold, "block").otherwise("allow")
    return scored.withColumns({"rule": F.lit(None).cast("string") if rule is None else rule, "verdict": model_says if verdict is None else verdict.otherwise(model_says)})
