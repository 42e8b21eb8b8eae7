"""Suffix dedup against a set of all 100-byte strings, on rows that are easily mistaken for one another."""

import hashlib
import random

from tidewheel.llm import suffix_dedup


def brute(rows):
    last = 1 << 63
    datas = [((last if i is None else i), (t or "").encode("utf-8", "surrogatepass")) for i, t in rows]
    first = {}
    for doc, data in datas:
        for a in range(len(data) - 99):
            key = hashlib.md5(data[a : a + 100]).digest()
            first[key] = min(first.get(key, (doc, a)), (doc, a))
    out = []
    for doc, data in datas:
        cut = bytearray(len(data))
        for a in range(len(data) - 99):
            if first[hashlib.md5(data[a : a + 100]).digest()] < (doc, a):
                cut[a : a + 100] = b"\1" * 100
        spans = sum(1 for i, c in enumerate(cut) if c and not (i and cut[i - 1]))
        kept = bytes(b for b, c in zip(data, cut) if not c)
        out.append((doc, len(data), sum(cut), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(spark, rows, schema="doc_id long, text string"):
    return sorted(((1 << 63) if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(spark.createDataFrame(rows, schema)).collect())


def test_repeats_null_ids_ties_and_clashing_columns(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    a, b, c = text(400), text(300), text(150)
    rows = [(1, a), (1, a), (1, b), (2, a), (3, b + c), (None, c), (None, c), (None, a[:50]), (4, c), (4, c + c), (5, None), (6, ""), (7, "x" * 1000), (8, "ab" * 300), (0, text(120) + a)]
    assert got(spark, rows) == brute(rows)
    more = [(i, t, 1, "z") for i, t in rows]
    assert got(spark, more, "doc_id long, text string, row int, own string") == brute(rows)
    assert got(spark, []) == []


def test_long_text(spark, monkeypatch):
    """Over a megabyte, with repeats across the edges of pieces and of groups that are settled together."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(160_000))
    text = text + text[524_000:525_500] + text[:300]
    rows = [(1, text), (2, "q" * 99 + text[700_000:701_000]), (3, "lo " * 5000)]
    assert len(text) > 1 << 20
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 5000)
    assert got(spark, rows) == brute(rows)
