"""URL filter: rules first, then logistic regression on hashed character n-grams, as DataFrame functions only.

The n-grams of host and path (each with its own hash seed and with end marks; a run of digits counts as one ``0``, so
that page numbers say nothing) fall into ``buckets`` buckets.  A url's logit is the sum of its n-grams' weights over the
root of their number, for host and path apart.  Weights are learned from a small labelled url table, of at most
``most_labels`` rows, whose n-grams one job hands to the driver.  Scoring is a fold over a url's n-grams: no shuffle, no
join and no Python.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule, and gets the verdict
of the bare intercept; repeated rows get the same answer, equal urls (and urls that differ in digits only) tie in score;
a very long url is scored whole; other columns (pages' html is never read) are ignored; an empty table gives an empty
table; without labels every score is a half, which is a block.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from math import exp
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    sizes: tuple[int, ...] = (3, 4, 5)
    buckets: int = 32768
    most_labels: int = 8192
    rounds: int = 12
    rate: float = 0.3
    ridge: float = 0.0005
    threshold: float = 0.5


# The rules.
RULES: tuple[tuple[str, str, str], ...] = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

# Stems of hosts to be blocked (gambling, pills, adult, advertising, spam, piracy, scams), stems of ordinary
# hosts, and frequent letter pairs of English, from which names that mean nothing are made.
BLOCK_STEMS = (
    "casino", "poker", "bets", "betting", "slots", "jackpot", "roulette", "lotto", "pills", "viagra", "cialis", "meds", "adult", "xxx", "porn", "sex",
    "escort", "cams", "nude", "ads", "adserver", "tracker", "track", "clicks", "popunder", "banner", "spam", "linkfarm", "crack", "keygen", "warez", "torrent",
    "payday", "loans", "replica", "prize",
)
BLOCK_ENDS = ("win", "free", "cheap", "farm", "best", "x", "now", "deal", "online", "hot", "bonus", "vip", "cash", "24")
ALLOW_STEMS = (
    "library", "university", "museum", "weather", "recipes", "garden", "history", "science", "news", "council", "hospital", "school", "travel", "music",
    "poetry", "software", "docs", "astronomy", "railway", "chess", "cycling", "archive", "bank", "health", "kitchen", "village", "theatre", "photo", "books", "sport",
    "forum", "maps", "energy", "water", "forest", "market", "hotel", "church", "radio", "film",
)
ALLOW_ENDS = ("club", "notes", "online", "city", "best", "group", "shop", "house", "now", "review", "free", "24", "centre", "x")
PAIRS = ("th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ve", "co", "me", "de", "hi", "ri", "ro", "ic", "ne", "ea")
# What hosts and paths of either kind have.
BEFORE = ("", "www.", "m.", "blog.", "shop.", "a1.")
AFTER = (".example.com", ".example.net", ".example.org", ".com", ".net", ".info")
PATHS = ("/en/1", "/de/2.html", "/fr/3/", "/es/4", "", "/", "/index.html", "/en/5/", "/fr/6.html", "/de/7", "/es/8.html", "/p/9")


def names() -> list[tuple[str, int]]:
    """Host names and their labels, 1 to be blocked: stems alone, joined to ends and to other stems of their kind, and made-up names."""
    out = []
    for stems, ends, label in ((BLOCK_STEMS, BLOCK_ENDS, 1), (ALLOW_STEMS, ALLOW_ENDS, 0)):
        for i, stem in enumerate(stems):
            out.append((stem, label))
            for k, end in enumerate(ends):
                out.append(((f"{end}-{stem}", f"{stem}{end}", f"{stem}-{end}", f"{end}{stem}")[crc32(f"{stem}{end}".encode()) % 4], label))
            for k in range(1, 8):
                other = stems[(i + 5 * k) % len(stems)]
                out.append((f"{stem}-{other}" if k % 2 else f"{stem}{other}", label))
    for i in range(800):
        picked = [PAIRS[crc32(f"{i}.{k}".encode()) % len(PAIRS)] for k in range(2 + i % 4)]
        out.append(("".join(picked), 0))
    return list(dict.fromkeys(out))


def labelled_urls(spark: SparkSession, of: Iterable[tuple[str, int]] | None = None, forms: int = 2) -> DataFrame:
    """The default table (url, label): each name in several forms of url, which are dealt out to both kinds alike."""
    rows = []
    for name, label in names() if of is None else of:
        for k in range(forms):
            before, after, path = (kind[crc32(f"{name}{k}{j}".encode()) % len(kind)] for j, kind in enumerate((BEFORE, AFTER, PATHS)))
            rows.append((f"http://{before}{name}{after}{path}", label))
    return spark.createDataFrame(rows, "url string, label int")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def grams(text: Column, seed: int, settings: Settings) -> Column:
    """Buckets of all character n-grams of one part of a url."""
    marked = F.concat(F.lit("^"), F.regexp_replace(text, "[0-9]+", "0"), F.lit("$"))

    def of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1)))
        # A function of one argument: with a second one it would get the element's place in the array.
        found = F.transform(places, lambda i: F.pmod(F.xxhash64(F.lit(seed), F.substring(marked, i, F.lit(n))), F.lit(settings.buckets)).cast("int"))
        return F.when(F.length(marked) >= n, found).otherwise(F.array().cast("array<int>"))

    return F.concat(*[of(n) for n in settings.sizes])


def both_grams(host: Column, path: Column, settings: Settings) -> list[Column]:
    return [grams(host, 1, settings).alias("of_host"), grams(path, 2, settings).alias("of_path")]


def _logit(weights: Sequence[float], intercept: float) -> Column:
    """From of_host and of_path.  Weights travel as one constant; the optimiser folds it into an array once."""
    table = F.split(F.lit(",".join(f"{w:.6g}" for w in weights)), ",").cast("array<double>")

    def part(g: str) -> Column:
        return F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda s, i: s + F.get(table, i)) / F.sqrt(F.size(g))).otherwise(F.lit(0.0))

    return F.lit(float(intercept)) + part("of_host") + part("of_path")


def train(labelled: DataFrame, settings: Settings = Settings()) -> tuple[list[float], float]:
    """Weights and intercept from (url, label), by passes of stochastic gradient descent in the order of the urls' hashes.

    One job hands over the n-grams of at most ``most_labels`` urls; both kinds weigh the same, however many there are.
    """
    host, path = parts(F.col("url"))
    known = labelled.filter("label in (0, 1)").select(F.col("label").cast("int").alias("y"), F.xxhash64("url", "label").alias("key"), *both_grams(host, path, settings))
    rows = known.limit(settings.most_labels + 1).collect()
    if len(rows) > settings.most_labels:
        raise ValueError(f"more than {settings.most_labels} labelled urls")
    bad = sum(r["y"] for r in rows)
    share = {1: len(rows) / max(1, 2 * bad), 0: len(rows) / max(1, 2 * (len(rows) - bad))}
    weights, seen, intercept = [0.0] * settings.buckets, [1e-6] * settings.buckets, 0.0
    found = [(r["y"], [(r[c], len(r[c]) ** -0.5) for c in ("of_host", "of_path") if r[c]]) for r in sorted(rows, key=lambda r: r["key"])]
    for _ in range(settings.rounds):
        for y, both in found:
            z = intercept + sum(x * sum(map(weights.__getitem__, g)) for g, x in both)
            e = (1 / (1 + exp(-max(-30.0, min(30.0, z)))) - y) * share[y]
            intercept -= settings.rate * 0.1 * e
            for g, x in both:
                for i in g:
                    d = e * x + settings.ridge * weights[i]
                    seen[i] += d * d
                    weights[i] -= settings.rate * d * seen[i] ** -0.5
    return weights, intercept


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, settings: Settings = Settings()) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score (probability of block)."""
    weights, intercept = train(labelled_urls(pages.sparkSession) if labelled is None else labelled, settings)
    host, path = parts(F.col("url"))
    split = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, fixed = rule_of(F.col("host"), F.col("path"), rules)
    ready = split.select("page_id", "host", "path", rule.alias("rule"), fixed.alias("fixed"), *both_grams(F.col("host"), F.col("path"), settings))
    scored = ready.select("page_id", "host", "path", "rule", "fixed", (1 / (1 + F.exp(-_logit(weights, intercept)))).alias("score"))
    verdict = F.coalesce("fixed", F.when(F.col("score") >= settings.threshold, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
