"""Null ids, repeats, ties, empty tables, clashing columns and long texts of the operators without a file of their own."""

import random

import pytest
from pyspark.sql import functions as F

from tidewheel.llm import decontaminate, host_rules, language_id, packing, url_filter

WORDS = {"en": "the house was cold and they went into it with light", "de": "das haus war kalt und sie gingen mit licht hinein", "fr": "la maison était froide et ils sont entrés avec une lampe"}


def prose(lang, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def test_host_verdict_flips_clean_rows(spark):
    """Four of five rows of one host fail: its clean rows go too; a small host with one failure keeps its others."""
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, good if i % 20 else "x y", f"h{i % 7}", 1) for i in range(700)]
    rows += [(1000 + i, good if i % 5 == 0 else "no", "bad", 1) for i in range(200)]
    rows += [(2000, good, "tiny", 1), (2001, "no", "tiny", 1), (None, good, None, 1), (None, good, None, 1), (3000, None, "h1", 1), (3001, "", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _w long")
    out = host_rules.judge(docs).collect()
    assert len(out) == len(rows)
    bad = [r for r in out if r.host == "bad"]
    assert not any(r.kept for r in bad) and sum(not r.base_failed for r in bad) == 40
    assert all(r.kept == (not r.base_failed) for r in out if r.host != "bad")
    assert sum(r.kept for r in out if r.host == "") == 2
    assert "_w" in host_rules.features(docs).columns
    assert host_rules.judge(docs.limit(0)).collect() == []


def test_host_rules_long_text_and_ties(spark):
    docs = spark.createDataFrame([(1, "a b c d e " * 40_000, "h"), (1, "a b c d e " * 40_000, "h"), (2, "same line\n" * 3, "h")], "doc_id long, text string, source string")
    got = [(r.doc_id, r.n_words, r.n_repeat_words, r.n_dup_lines) for r in host_rules.judge(docs).orderBy("doc_id").collect()]
    assert got == [(1, 200_000, 200_000, 0), (1, 200_000, 200_000, 0), (2, 6, 0, 2)]


def test_language_edges(spark):
    rows = [(i, prose(lang, 40, i), lang) for i, lang in enumerate(list(WORDS) * 40)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = [(None, prose("de", 30, 500)), (1, None), (1, "123 --"), (2, prose("en", 150_000, 501)), (2, prose("fr", 20, 502)), (2, prose("fr", 20, 502))]
    got = [(r.doc_id, r.lang_pred, 0 <= r.score <= 1) for r in language_id.predict(spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 AS score", "text AS lang_pred"), model).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None, "de", True), (1, "und", True), (1, "und", True), (2, "en", True), (2, "fr", True), (2, "fr", True)]))
    assert language_id.predict(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []


def test_packing_edges(spark):
    rows = [(None, "some words"), (1, None), (1, None), (2, ""), (3, "tie " * 50), (4, "tie " * 50), (5, "long word " * 30_000)]
    cut = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS length"))
    out = packing.pack(cut).collect()
    assert len(out) == cut.count() and sum(r.length for r in out) == sum(r.doc_tokens for r in out if r.start == 0)
    at = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= packing.CAPACITY and [r.doc_tokens for r in out if r.doc_id in (1, 2)] == [1, 1, 1]
    assert packing.pack(packing.pieces(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_decontamination_edges(spark):
    rng = random.Random(7)
    item = " ".join(f"q{rng.randrange(4000)}" for _ in range(30))
    filler = " ".join(f"w{rng.randrange(4000)}" for _ in range(30_000))
    docs = [(None, item), (1, None), (2, ""), (3, filler + " " + item), (4, item), (4, item), (5, filler)]
    bench = spark.createDataFrame([(1, item), (1, item), (None, item), (2, None), (3, "")], "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS words")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, bench).collect()} == {(3, 1), (4, 1)}
    assert decontaminate.contaminated(d.limit(0), bench).collect() == [] and decontaminate.contaminated(d, bench.limit(0)).collect() == []


@pytest.fixture(scope="module")
def split(spark):
    """The labelled URLs in two halves by a hash of the name, so that no name is in both."""
    urls = url_filter.labelled_urls(spark).selectExpr("url", "blocked", "pmod(xxhash64(split(regexp_replace(url, '^[a-z]+://(www[.])?', ''), '[./]')[0]), 4) = 0 AS held")
    return urls.where("NOT held"), urls.where("held")


def test_url_filter_held_out_names(spark, split):
    model = url_filter.fit(split[0].select("url", "blocked"))
    held = split[1].selectExpr("url", "blocked", "monotonically_increasing_id() AS page_id").collect()
    judged = {r.page_id: r for r in url_filter.judge(spark.createDataFrame([(r.page_id, r.url) for r in held], "page_id long, url string"), model, rules=()).collect()}
    hits = sum(judged[r.page_id].verdict == "block" and bool(r.blocked) for r in held)
    said, there = sum(r.verdict == "block" for r in judged.values()), sum(bool(r.blocked) for r in held)
    # Names are unseen, so only parts of them help; 89 of 98 found and 2 of 178 wrong were measured.
    assert hits / said >= 0.9 and hits / there >= 0.8, (hits, said, there)


def test_grams_are_the_distinct_hashed_pieces_of_three_to_five_characters(spark):
    import xxhash

    signed = lambda h: h - 2**64 if h >= 2**63 else h
    urls = ["http://Ab.org/x?q", "http://a", "http://é.x/日本🙂\n/ab", "", "a://"]
    host, path = url_filter.host_and_path(F.col("url"))
    got = spark.createDataFrame([(u,) for u in urls], "url string").select("url", host.alias("h"), path.alias("p"), url_filter.grams(host, path).alias("g")).collect()
    for r in got:
        s = f"^{r.h}{r.p.translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))}$"
        want = {signed(xxhash.xxh64(s[i : i + n].encode(), 42).intdigest()) % url_filter.BUCKETS for n in url_filter.GRAMS for i in range(len(s) - n + 1)}
        assert set(r.g) == want and len(r.g) == len(want), r.url


def test_a_url_of_a_million_characters(spark):
    import time

    began = time.time()
    pages = spark.createDataFrame([(1, "http://x.org/" + "abcdefghij" * 100_000)], "page_id long, url string")
    row = url_filter.judge(pages, ([0.0] * url_filter.BUCKETS, -1.0)).first()
    assert row.verdict == "allow" and len(row.path) == 1_000_001 and time.time() - began < 60


def test_url_edges(spark):
    rows = [(None, "http://a.org/x"), (1, None), (1, None), (2, ""), (3, "http://" + "long/" * 800), (4, "://"), (4, "x://HOST?q"), (5, "no scheme")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS verdict")
    out = url_filter.judge(pages, ([0.0] * url_filter.BUCKETS, -1.0)).collect()
    assert len(out) == len(rows) and all(r.verdict == "allow" for r in out)
    assert sorted((r.host, r.path) for r in out if r.page_id in (1, 2, 4, 5)) == [("", ""), ("", ""), ("", ""), ("", ""), ("", ""), ("host", "")]
    assert url_filter.judge(pages.limit(0), ([0.0] * url_filter.BUCKETS, -1.0)).collect() == []
