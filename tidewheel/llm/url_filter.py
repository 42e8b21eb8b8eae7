"""URL filters: listed rules first, then logistic regression on hashed character n-grams of host and path.

DataFrame functions alone: features, gradients and scores are column expressions. The model is an array
of a fixed number of weights, fitted by gradient descent on a small labelled table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

BUCKETS = 4096
GRAMS = (3, 4, 5)
STEPS = 30
RATE = 3.0
DECAY = 1e-5
#: Block above this probability.
MAX_P = 0.5
# The rules, as host and path, with their verdicts.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BLOCKED = (
    "casino poker jackpot slots betting roulette gamble spam spamlinks linkfarm farm-links adult xxx porn escort hookup "
    "nude viagra cialis pills pharma-cheap loans payday quick-cash free-money get-rich prize winner win-big malware virus phish "
    "fake-login crack keygen warez torrent replica cheap-watch click-bait popup-ads"
).split()
_ALLOWED = (
    "news blog shop docs wiki museum library school weather recipes travel garden music history science gallery forum "
    "support help city hotel books radio health sports theatre market farmers-guide winery adulteducation betterhomes "
    "university research journal archive community calendar"
).split()
_SYLLABLES = "the th an re er on in ing tion ble he st en ha es wh is ou nt ed or at le ar ro li ma ne so".split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, blocked): a small table made by rule from listed words; ordinary names are also joined from syllables."""
    top = F.element_at(F.array(*map(F.lit, ("com", "org", "net"))), (F.col("k") % 3 + 1).cast("int"))
    sub = F.element_at(F.array(*map(F.lit, ("", "www.", "m.", "blog."))), (F.col("k") % 4 + 1).cast("int"))
    lang = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("k") % 4 + 1).cast("int"))
    tail = F.element_at(F.array(*map(F.lit, ("-x", "-win", "24", "", "-zone", "-farm", "-top"))), (F.col("k") % 7 + 1).cast("int"))

    def listed(words: list[str], n: int, blocked: bool) -> DataFrame:
        word = F.explode(F.array(*map(F.lit, words))).alias("word")
        return spark.range(0, n, 1, 1).select("id", word).select(F.pmod(F.xxhash64("id", "word"), F.lit(9973)).alias("k"), F.col("word").alias("name"), F.lit(blocked).alias("blocked"))

    syl = F.array(*map(F.lit, _SYLLABLES))
    part = lambda j: F.element_at(syl, (F.pmod(F.xxhash64("id", F.lit(j)), F.lit(len(_SYLLABLES))) + 1).cast("int"))
    made = spark.range(0, 600, 1, 1).select(F.pmod(F.xxhash64("id"), F.lit(9973)).alias("k"), F.concat(part(1), part(2), F.when(F.col("id") % 2 == 0, part(3)).otherwise("")).alias("name"), F.lit(False).alias("blocked"))
    rows = listed(_BLOCKED, 12, True).withColumn("name", F.concat("name", tail)).unionByName(listed(_ALLOWED, 5, False)).unionByName(made)
    url = F.concat(F.when(F.col("k") % 2 == 0, "http://").otherwise("https://"), sub, "name", F.when(F.col("k") % 3 == 1, ".example.").otherwise("."), top, F.lit("/"), lang, F.lit("/"), F.col("k").cast("string"))
    return rows.select(url.alias("url"), "blocked")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where url is null or has no ``://``. Only A-Z are lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def grams(host: Column, path: Column) -> Column:
    """Distinct hashed n-grams, as places among the weights.

    The characters are cut apart once, so the work grows with the length of the url, however long it is.
    """
    s = F.regexp_extract_all(F.concat(F.lit("^"), host, F.translate(path, UPPER, LOWER), F.lit("$")), F.lit("(?s)."), F.lit(0))
    places = lambda chars, n: F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    gram = lambda chars, i, n: F.pmod(F.xxhash64(F.concat(*(F.get(chars, i + k) for k in range(n)))), F.lit(BUCKETS)).cast("int")
    every = lambda chars: F.concat(*(F.transform(places(chars, n), _at(gram, chars, n)) for n in GRAMS))
    return F.array_distinct(F.flatten(F.transform(F.array(s), every)))


def _at(gram, chars: Column, n: int):
    return lambda i: gram(chars, i, n)


def _margin(idx: Column, weights: list[float], bias: float) -> Column:
    w = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate(idx, F.lit(0.0), lambda s, i: s + F.get(w, i))
    return F.lit(bias) + total / F.sqrt(F.greatest(F.size(idx), F.lit(1)).cast("double"))


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", steps: int = STEPS) -> tuple[list[float], float]:
    """Weights and bias by adaptive gradient descent with a quadratic penalty.

    Rows with a null label are left out. What comes back at each step is at most one number for each
    weight, whatever the number of rows. Without rows of both kinds all weights are 0 and nothing is blocked.
    """
    host, path = host_and_path(F.col(url_col))
    rows = labelled.where(F.col(label_col).isNotNull()).select(grams(host, path).alias("idx"), F.col(label_col).cast("double").alias("y"))
    rows = written(rows, "url-features")
    n, mean = rows.agg(F.count("*"), F.avg("y")).first()
    weights, bias = [0.0] * BUCKETS, -1.0
    if not n or mean in (0.0, 1.0):
        return weights, bias
    bias, seen, own = 0.0, [1e-8] * BUCKETS, 1e-8
    weight = F.when(F.col("y") > 0, 0.5 / mean).otherwise(0.5 / (1 - mean))
    for _ in range(steps):
        p = 1 / (1 + F.exp(-_margin(F.col("idx"), weights, bias)))
        r = rows.select("idx", ((p - F.col("y")) * weight / n).alias("g"))
        each = r.select(F.explode(F.concat("idx", F.array(F.lit(BUCKETS)))).alias("i"), F.when(F.col("i") == BUCKETS, F.col("g")).otherwise(F.col("g") / F.sqrt(F.greatest(F.size("idx"), F.lit(1)).cast("double"))).alias("d"))
        for i, d in each.groupBy("i").agg(F.sum("d")).collect():
            if i == BUCKETS:
                own += d * d
                bias -= RATE * d / own**0.5
            else:
                d += DECAY * weights[i]
                seen[i] += d * d
                weights[i] -= RATE * d / seen[i] ** 0.5
    return weights, bias


def judge(pages: DataFrame, model: tuple[list[float], float], id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, max_p: float = MAX_P) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block), a row for each input row.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest wins, and
    of equally long ones the first listed. Null urls and urls without ``://`` have an empty host and path
    and are allowed. Null ids and repeated rows stay as they come.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    own = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, rule_verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the last that fits wins: the longest
        fits = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
        rule, rule_verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(rule_verdict)
    idx = F.when(F.col("host") == "", F.array().cast("array<int>")).otherwise(grams(F.col("host"), F.col("path")))
    p = F.when(F.col("host") == "", F.lit(0.0)).otherwise(1 / (1 + F.exp(-_margin(F.col("idx"), *model))))
    return own.select("*", rule.alias("rule"), rule_verdict.alias("rule_verdict"), idx.alias("idx")).select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(p > max_p, "block").otherwise("allow")).alias("verdict"), F.round(p, 6).alias("p_block")
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url, as judge() states them for nulls, ties, repeats and long urls; an empty table gives no rows."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), fit(labelled_urls(spark)))
