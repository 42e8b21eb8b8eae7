"""Quality rules by host: rule failures of a domain, shrunk with an empirical beta prior, join back as verdicts.

Built from DataFrame functions alone. Windows are compared inside each row, so that no word is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salted_join, written

WINDOW = 5
MIN_WORDS = 10
#: Repeated windows of a text that are looked up one by one; more are found by sorting.
FEW = 32
MAX_REPEAT_PERCENT = 20
#: A host goes if its failure rate is, for SURE standard deviations, above this or above EXCESS times the corpus's.
MAX_HOST_RATE = 0.5
EXCESS = 3.0
#: 95 percent, one-sided.
SURE = 1.645
#: Hosts with fewer documents say nothing about the prior's spread.
MIN_HOST_DOCS = 5
_SPACES = "[\\x20\\x09-\\x0D]+"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once: an element bound by a lambda is not copied into the places that use it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _covered(places: Column) -> Column:
    """Words that windows at these sorted places cover."""
    gaps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)


def _sorted_places(hashes: Column) -> Column:
    """Places of repeated windows, by sorting (hash, place) and keeping those with an equal neighbour."""

    def of_ranked(ranked: Column) -> Column:
        n = F.size(ranked)
        is_same = lambda x, i: ((i > 0) & (F.get(ranked, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(ranked, i + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(F.filter(ranked, is_same), lambda x: x["i"]))

    return _let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_ranked)


def _places(hashes: Column, twice: Column) -> Column:
    """Places of windows whose hash is among twice: looked up where those are few, else by sorting."""
    few = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda i: i.isNotNull())
    return F.when(F.size(twice) <= FEW, few).otherwise(_sorted_places(hashes))


def _repeat_words(hashes: Column) -> Column:
    """Words that repeated windows cover."""
    twice = lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1)))
    return _let(F.sort_array(hashes), lambda s: _let(twice(s), lambda t: _let(_places(hashes, t), _covered)))


def _repeats(h: Column) -> Column:
    """Words that repeated 5-word windows cover, from the words' hashes.

    Hashes of pairs, then of pairs of pairs; only where four words repeat is the fifth taken in.
    """
    pair = lambda a, b: F.xxhash64(a, b)
    n = F.size(h)
    fours = lambda two: F.slice(F.zip_with(two, F.slice(two, 3, n), pair), 1, n - WINDOW + 2)
    fives = lambda four: F.slice(F.zip_with(four, F.slice(h, 5, n), pair), 1, n - WINDOW + 1)
    differ = lambda x: F.size(F.array_distinct(x)) == F.size(x)
    of_fives = lambda x: F.when(differ(x), F.lit(0)).otherwise(_repeat_words(x))
    of_fours = lambda x: F.when(differ(x), F.lit(0)).otherwise(_let(fives(x), of_fives))
    return _let(F.zip_with(h, F.slice(h, 2, n), pair), lambda two: _let(fours(two), of_fours))


def _of_words(words: Column) -> Column:
    """(n, chars, repeats) of an array of words."""
    n = F.size(words)
    repeats = F.when(n < WINDOW, F.lit(0)).otherwise(_let(F.transform(words, lambda w: F.xxhash64(w)), _repeats))
    return F.struct(n.cast("long").alias("n"), F.length(F.array_join(words, "")).cast("long").alias("chars"), repeats.cast("long").alias("repeats"))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) and base_failed.

    A null or empty text has no words, so it fails. Existing columns of these names are replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, _SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))
    own = "_w"
    while own in docs.columns:
        own += "_"
    out = docs.withColumns({
        own: _let(words, _of_words),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    })
    out = out.withColumns({"n_words": F.col(own)["n"], "word_chars": F.col(own)["chars"], "n_repeat_words": F.col(own)["repeats"]}).drop(own)
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(judged: DataFrame, host: str, failed: str = "base_failed", max_rate: float = MAX_HOST_RATE, excess: float = EXCESS) -> DataFrame:
    """(host, n, n_failed, rate, host_ok). rate = (n_failed + a) / (n + a + b); a and b by the moments of the hosts' own rates.

    The prior is a + b = m (1 - m) / v - 1 held to [1, 1000], where m is the share of failures over all
    documents and v the variance of the rates of hosts with MIN_HOST_DOCS or more. With no such variance
    the hosts are alike: a + b = 1000. Null hosts are one host; without documents there is no host.

    A host is bad if its rate less SURE standard deviations of its beta posterior is still above the least of max_rate
    and excess times m: so few documents never make a bad host, and what is bad follows the corpus.
    """
    by = judged.groupBy(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    big = F.col("n") >= MIN_HOST_DOCS
    prior = by.agg(
        (F.sum("n_failed") / F.sum("n")).alias("m"),
        F.var_pop(F.when(big, F.col("n_failed") / F.col("n"))).alias("v"),
    )
    m = F.col("m")
    size = F.when(F.col("v") > 0, F.least(F.greatest(m * (1 - m) / F.col("v") - 1, F.lit(1.0)), F.lit(1000.0))).otherwise(F.lit(1000.0))
    # One row of priors joins every host by a constant key: a fixed size of two numbers.
    both = by.withColumn("k", F.lit(1)).join(F.broadcast(prior.select(m, size.alias("s"), F.lit(1).alias("k"))), "k")
    rows = F.col("n") + F.col("s")
    both = both.withColumn("rate", (F.col("n_failed") + m * F.col("s")) / rows)
    surely = F.col("rate") - SURE * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (rows + 1))
    return both.select("host", "n", "n_failed", "rate", (surely <= F.least(F.lit(max_rate), excess * m)).alias("host_ok"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE, excess: float = EXCESS) -> DataFrame:
    """A row for each row of docs: id, features, base_failed, host_rate and kept.

    kept: the row does not fail itself, and its host is not bad. Repeated rows and null ids stay as they come, null
    hosts are one host, null and empty texts fail; an empty table stays empty.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"))
    # Counted once: hosts and documents both read this table of numbers.
    judged = written(features(own).drop("text"), "judged")
    verdicts = host_verdicts(judged, "host", max_rate=max_rate, excess=excess).select("host", F.col("rate").alias("host_rate"), "host_ok")
    return salted_join(judged.withColumn("by", F.xxhash64("doc_id", "n_words", "word_chars")), verdicts, "host", "by", judged).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("host_ok")).alias("kept"), "host", F.round("host_rate", 9).alias("host_rate"),
    )


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_OP10 = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT doc_id, i, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, host, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
h AS (SELECT host, count(*) AS n, sum(base_failed::BIGINT)::BIGINT AS nf FROM b GROUP BY host),
p AS (SELECT sum(nf) / sum(n) AS m, var_pop(CASE WHEN n >= 5 THEN nf / n END) AS v FROM h),
s AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 1000.0) ELSE 1000.0 END AS s FROM p),
r0 AS (SELECT host, m, n + s AS rows, (nf + m * s) / (n + s) AS rate FROM h, s),
r AS (SELECT host, rate, rate - 1.645 * sqrt(rate * (1 - rate) / (rows + 1)) <= least(0.5, 3 * m) AS host_ok FROM r0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_ok AS kept, host, round(rate, 9) AS host_rate
FROM b JOIN r USING (host)
"""
