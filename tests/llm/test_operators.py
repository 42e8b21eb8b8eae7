"""The training-data operators on small rows: brute force, empty tables, nulls, repeated rows, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("tidewheel.llm")

from tidewheel.llm import class_lm, decontaminate, host_rules, language_id, near_dedup, packing, secret_scan, suffix_dedup, toxicity, url_filter  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, score double, n_words string, row int"


def docs(spark, texts, lang="en"):
    rows = [(i, t, lang, f"s{(i or 0) % 3}", 1.0, "x", 7) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def prose(n, seed, words=400):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(words)]
    return " ".join(r.choice(vocabulary) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "no id here"), (4, "one"), (5, "same text twice over and over"), (5, "same text twice over and over"), (6, "é ß 漢字 \x00 end")]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_secret_spans(spark):
    key = "aB3xK9mQ2wE7rT5yU1iO8pL4"
    text = f'token = "{"0123456789abcdef" * 2}" password: abc12 AKIA{"A1" * 10} {key}'
    got = by_id(secret_scan.scan(docs(spark, [*ODD, (9, text)])))
    kinds = [s["kind"] for s in got[9]["spans"]]
    assert kinds[:3] == ["assign", "hex", "access"] and kinds[3:] == ["markov"]
    assert all(not got[i]["spans"] for i in (1, 2, 3, 4, 5))
    assert secret_scan.scan(docs(spark, [])).count() == 0
    clean = by_id(secret_scan.redacted(docs(spark, [(9, text)])))[9]["text"]
    assert "0123456789abcdef" not in clean and "abc12" in clean
    assert secret_scan.base_spans("token: token: abcdefgh") == []


def test_host_rules_by_hand(spark):
    repeated = "a b c d e f a b c d e g h i j"
    got = by_id(host_rules.judge(docs(spark, [*ODD, (9, repeated), (10, "x y\nx y\n" + prose(30, 1))])))
    assert (got[9]["n_words"], got[9]["n_repeat_words"], got[9]["base_failed"]) == (15, 10, True)
    assert got[10]["n_dup_lines"] == 1
    assert got[1]["n_words"] == 0 and not got[1]["kept"]
    assert host_rules.judge(docs(spark, [])).count() == 0


def test_url_rules(spark):
    urls = [(1, "HTTP://A.Example.NET/en/x?q"), (2, "x://b.net/"), (3, "http://example.com/de/1#a"), (4, None), (5, "nothing"), (6, "https://q.org/fr/"), (7, "http://example.net.evil.com/en/")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, ([0.0] * url_filter.BUCKETS, -1.0)).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2]["verdict"] == "block" and got[3]["rule"] == "example.com/de/" and got[6]["rule"] == "org/fr/"
    assert got[4]["host"] == "" and got[5]["verdict"] == "allow" and got[7]["rule"] is None


def test_near_dedup_against_brute_force(spark):
    r = random.Random(5)
    texts, base = [], [prose(60, s).split() for s in range(6)]
    for i in range(60):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            w[r.randrange(len(w))] = "zz" + str(r.randrange(9))
        texts.append((i, " ".join(w)))
    texts += [(100 + i, t) for i, t in ODD if i is not None] + [(None, texts[0][1])]
    got = near_dedup.near_duplicates(docs(spark, texts)).collect()
    sets = {}
    for i, t in texts:
        w = (t or "").lower().split()
        sets.setdefault(i, set()).update({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = {i: i for i in sets if i is not None}
    for _ in root:
        for i in root:
            for j in root:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    for row in got:
        if row["doc_id"] is None:
            assert row["kept"] and row["component_id"] is None
        else:
            assert row["component_id"] == root[row["doc_id"]] and row["kept"] == (row["doc_id"] == root[row["doc_id"]])
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    passage, other = prose(40, 1), prose(200, 2)
    texts = [(1, prose(50, 3) + passage + prose(20, 4)), (2, passage), (3, other), (4, other), (5, "x" * 350), (6, None), (7, prose(9, 5) + passage[30:180] + "é"), (8, other[:99])]
    got = by_id(suffix_dedup.dedup(docs(spark, texts)))
    seen = set()
    for i, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest() and got[i]["n_spans"] == len([x for x in bytes(gone).split(b"\0") if x])
    assert suffix_dedup.dedup(docs(spark, [])).count() == 0


def test_deep_shallow_orders():
    r = random.Random(2)
    rows = [bytes(r.choice(b"ab") for _ in range(4)) + b"z" * 40 + bytes(r.choice(b"abc") for _ in range(12)) for _ in range(200)]
    strings = np.frombuffer(b"".join(rows), np.uint8).reshape(200, 56)
    order, common = suffix_dedup.deep_shallow(np.zeros(200, np.int64), strings)
    assert [rows[i] for i in order] == sorted(rows)
    assert all(rows[order[i]][: common[i]] == rows[order[i - 1]][: common[i]] for i in range(1, 200))


def test_packing_places_every_id_once(spark):
    from tokenizers import Tokenizer

    texts = [*[(i, prose(30 * (i % 17) + 1, i)) for i in range(10, 60)], (1, None), (2, prose(2500, 9))]
    got = packing.pack(packing.pieces(docs(spark, texts))).collect()
    model = Tokenizer.from_file(packing.tokenizer_path())
    for i, t in texts:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def test_class_lm_base_score(spark):
    texts = [(i, prose(40, i % 4)) for i in range(30)] + [(40, None)]
    d = docs(spark, texts)
    counts = class_lm.count_words(d.select("text"))
    n = {bytes(r["word"]): r["n"] for r in counts.collect()}
    whole, some = (by_id(class_lm.score(d, class_lm.train(d.select("text"), counts, head=h, clustered=20), counts)) for h in (10**6, 50))
    total, v = sum(n.values()), len(n)
    for i, t in texts:
        w = [*(t or "").encode().split(), class_lm.END]
        want = sum(np.log10((n[x] + 0.5) / (total + 0.5 * (v + 1))) for x in w)
        assert whole[i]["base_score"] == pytest.approx(want) and some[i]["base_score"] == pytest.approx(want) and whole[i]["n_known"] == some[i]["n_known"] == len(w)
    empty = docs(spark, [])
    assert class_lm.score(empty, class_lm.train(empty.select("text"), class_lm.count_words(empty.select("text"))), class_lm.count_words(empty.select("text"))).count() == 0


def test_language_and_toxicity_learn(spark):
    en, de = "the of and to in is that it was for", "der die und das ist nicht ein mit sich auf"
    make = lambda words, s: " ".join(random.Random(s).choices(words.split(), k=30))
    rows = [(i, make(en if i % 2 else de, i), "en" if i % 2 else "de", "s", 1.0, "x", 7) for i in range(80)] + [(99, None, None, "s", 1.0, "x", 7), (98, "12 34", "en", "s", 1.0, "x", 7)]
    d = spark.createDataFrame(rows, SCHEMA)
    model = language_id.train(d)
    got = by_id(language_id.predict(d, model))
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(80)) and got[99]["lang_pred"] == got[98]["lang_pred"] == "und"
    assert language_id.accepted(d, model).count() == 80
    assert by_id(language_id.predict(d, language_id.train(d.limit(0))))[1]["lang_pred"] == "und"
    toxic = d.where("doc_id < 80").selectExpr("doc_id", "CASE WHEN doc_id % 4 = 0 THEN concat(text, ' vilest') ELSE text END AS text")
    labels = toxic.selectExpr("doc_id", "cast(doc_id % 4 = 0 AS int) AS toxic")
    scores = by_id(toxicity.score(toxic, toxicity.train(toxic, labels)))
    assert min(scores[i]["score"] for i in range(0, 80, 4)) > max(scores[i]["score"] for i in range(80) if i % 4)
    assert 0 <= by_id(toxicity.score(d, toxicity.train(d, labels.limit(0))))[99]["score"] <= 1


def test_decontamination_finds_paraphrases(spark):
    items = [(i, prose(30, 900 + i, 3000)) for i in range(8)]
    r = random.Random(4)
    words = items[3][1].split()
    for k in (2, 9, 16):
        words[k] = "other" + str(k)
    texts = [(i, prose(150, i, 3000)) for i in range(40)]
    texts += [(100, prose(60, 70, 3000) + " " + items[1][1].upper() + ". " + prose(40, 71, 3000)), (101, prose(50, 72, 3000) + " " + " ".join(words)), (102, None), (103, "")]
    bench = spark.createDataFrame([*items, (50, None), (51, "")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got == {(100, 1), (101, 3)}
    assert decontaminate.contaminated(docs(spark, texts), bench.limit(0)).count() == 0
    assert r and re


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    clean = [(i, prose(80, i, 3000)) for i in range(20)]
    item = prose(30, 999, 3000)
    more = [(50, clean[3][1]), (51, prose(30, 60, 3000) + " " + item), (52, "12 34"), (53, clean[4][1] + " token = " + "0123456789abcdef" * 2)]
    docs(spark, clean + more).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) AS long) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i for i, _ in clean}


def test_decontamination_holds_many_items(spark):
    items = [(i, prose(30, 5000 + i, 3000)) for i in range(600)]
    texts = [(i, prose(60, i, 3000) + " " + t + " " + prose(60, 900 + i, 3000)) for i, t in items]
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i, _ in items}


def matches_by_brute_force(texts, items):
    """Pairs whose item's and answer's words are in some passage's common subsequence, for all passages and items."""
    ids = lambda t: decontaminate.word_ids(decontaminate.plain_words(t), decontaminate.WordHashes()).tolist()
    every = [(i, ids(t), ids(decontaminate.answer_of(t))) for i, t in items]
    out = set()
    for doc, text in texts:
        words = ids(text)
        for i, item, answer in every:
            size, item_bits, answer_bits = decontaminate.size_of(len(item)), decontaminate.bits_of(item), decontaminate.bits_of(answer)
            for a in range(0, max(1, len(words) - size // 2), size // 2):
                around = words[max(0, a - size // 4) : a + size + size // 4]
                if decontaminate.lcs(item_bits, len(item), around) >= 0.6 * len(item) and decontaminate.lcs(answer_bits, len(answer), around) >= 0.5 * len(answer):
                    out.add((doc, i))
                    break
    return out


def test_decontamination_finds_hot_and_common_items(spark):
    common = prose(60, 1, 60).split()
    r = random.Random(8)
    every = [(i, " ".join(r.choice(common) for _ in range(30))) for i in range(30)] + [(30 + i, prose(30, 700 + i, 3000)) for i in range(5)]
    hot = every[30][1].split()
    hot[3::4] = [f"other{k}" for k in range(len(hot[3::4]))]
    texts = []
    for i in range(150):
        words = [r.choice(common) if r.random() < 0.5 else f"w{r.randrange(3000)}" for _ in range(90)]
        k = r.randrange(60)
        if i % 3 == 0:
            words[k:k] = hot
        elif i % 3 == 1:
            words[k:k] = [w for w in every[i % 29][1].split() if r.random() < 0.85]
        texts.append((i, " ".join(words)))
    texts.append((150, prose(40, 5, 3000) + " " + every[30][1]))
    expected = matches_by_brute_force(texts, every)
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(docs(spark, texts), spark.createDataFrame(every, "item_id long, text string")).collect()}
    assert {(i, 30) for i in range(0, 151, 3)} <= expected and len(expected) > 90
    assert got == expected


def test_latent_products_retrieve_what_counts_would_and_little_else():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([5, 14, 30, 60])))) for k in range(40)]
    texts = [" ".join(rng.choices(vocabulary + ["other"] * 400, k=300)) for _ in range(60)]
    for k in range(0, 40, 2):  # every third word of a leak is another
        words = [w if i % 3 else "replaced" for i, w in enumerate(items[k][1].split())]
        texts[k] = " ".join([texts[k][:200], *words, texts[k][200:]])
    texts[1] = " ".join(["w1"] * 50 + [items[3][1]] + ["w2"] * 50)
    hashes = decontaminate.WordHashes()
    ids = [decontaminate.word_ids(decontaminate.plain_words(t), hashes) for t in texts]
    space = decontaminate.Space(items, np.ones(decontaminate.BUCKETS), len(ids))
    n = len(space.words)
    rows = np.zeros((len(space.rows), n))
    for j, (at, x) in enumerate(space.rows):
        rows[j, at] = x
    latent = decontaminate.Latent(space, np.linalg.svd(rows, full_matrices=False)[2].T.astype(np.float32))
    want = set()
    for d, x in enumerate(ids):
        place = space.place[x & np.uint32(decontaminate.BUCKETS - 1)]
        for size in space.sizes:
            for begin in range(0, max(1, len(x) - size // 2), size // 2):
                held = place[max(0, begin - size // 4) : begin + size + size // 4]
                held = held[held >= 0]
                for j in range(len(space.items)):
                    if space.size_of[j] == size and space.has[held, j].sum() >= space.need[j] and space.times[np.unique(held), j].sum() >= space.need[j]:
                        want.add((d, begin, size, j))
    got = {(d, begin, size, int(j)) for d, begin, size, _, found in decontaminate.retrieved(ids, space, latent) for j in found}
    assert got == want and want
    latent.least[:] = np.iinfo(latent.kind).max  # nothing is found but through these products
    assert not list(decontaminate.retrieved(ids, space, latent))
