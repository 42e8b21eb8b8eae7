"""The Kneser-Ney models of toxicity: distributions sum to one and agree with a plain count; texts at the edges."""

import random

import numpy as np
import pytest

from tidewheel.llm import toxicity
from tidewheel.llm.common import plain_words

WORDS = [b"trash", b"trashy", b"the", b"then", b"hen", b"a", b"ab", "réeux".encode(), b"abcabcabcabcabcabc"]
TOXIC = np.array([3, 1, 1, 0, 0, 1, 0, 2, 1], float)
ORDINARY = np.array([0, 0, 5, 2, 1, 4, 1, 0, 0], float)


def test_distributions_sum_to_one():
    f = toxicity.fitted(WORDS, TOXIC, ORDINARY)
    n = len(f["contexts"])
    seen_lower = np.bincount(f["context"], weights=f["lower"], minlength=n)
    for p, rest in zip(f["p"], f["rest"], strict=True):
        # What was seen after a context, and the shared mass of all else.
        assert np.bincount(f["context"], weights=p, minlength=n) + rest * (1 - seen_lower) == pytest.approx(1.0)
        assert (p > 0).all() and (rest > 0).all() and (rest <= 1).all()
    unigrams = f["orders"][0][1]
    assert unigrams.sum() < 1 and toxicity._discount(np.array([1.0, 5.0])) < 1


def test_agrees_with_plain_counts():
    """Likelihood ratios of words, seen and new, from dictionaries."""
    sym = lambda w: (1, *(b + 2 for b in w), 258)
    order = toxicity.ORDER
    orders = []
    for k in range(1, order):
        grams = {s[i - k : i + 1] for s in map(sym, WORDS) for i in range(k, len(s))}
        c = {}
        for g in grams:
            c[g[1:]] = c.get(g[1:], 0) + 1
        orders.append(c)
    discounts = [toxicity._discount(np.array(list(c.values()), float)) for c in orders]

    def shared(g):
        if not g:
            return 1 / toxicity.SYMBOLS
        c, d = orders[len(g) - 1], discounts[len(g) - 1]
        after = {h: n for h, n in c.items() if h[:-1] == g[:-1]}
        total = sum(after.values())
        if not total:
            return shared(g[1:])
        return max(c.get(g, 0) - d, 0) / total + d * len(after) / total * shared(g[1:])

    def likelihood(word, weights):
        top = {}
        for w, n in zip(WORDS, weights, strict=True):
            s = sym(w)
            for i in range(1, len(s)):
                g = s[max(0, i - order + 1) : i + 1]
                top[g] = top.get(g, 0) + n
        out, s = 0.0, sym(word)
        for i in range(1, len(s)):
            g = s[max(0, i - order + 1) : i + 1]
            after = {h: n for h, n in top.items() if h[:-1] == g[:-1] and n}
            total = sum(after.values())
            p = shared(g[1:]) if not total else max(top.get(g, 0) - toxicity.DISCOUNT, 0) / total + toxicity.DISCOUNT * len(after) / total * shared(g[1:])
            out += np.log(p)
        return out

    model = toxicity.spelling(WORDS, TOXIC, ORDINARY)
    for word in [*WORDS, b"trashes", b"th", b"zebra", b"x" * 40, b"abcabcabcabcabcabcabc"]:
        assert model.of([word])[0] == pytest.approx(likelihood(word, TOXIC) - likelihood(word, ORDINARY), abs=1e-9)


def test_held_out_and_edges(spark):
    rng = random.Random(2)
    plain = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(40)]
        if i % 4 == 0:
            words[rng.randrange(40)] = rng.choice(["scumbag", "scumbags", "idiotic", "idiot"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d.where("doc_id < 300"), l.where("doc_id < 300"))
    got = {r.doc_id: r.score for r in toxicity.score(d.where("doc_id >= 300"), model).collect()}
    assert all((s >= toxicity.CUTOFF) == (i % 4 == 0) for i, s in got.items())
    rows = [(None, "word1"), (1, None), (1, ""), (2, "!!! ..."), (3, "word1 " * 200_000), (3, "word1 " * 200_000), (4, "a" * 300_000 + " scumbag")]
    edge = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS score", "text AS y"), model).collect()
    assert len(edge) == 7 and all(0 <= r.score <= 1 for r in edge) and len({r.score for r in edge if r.doc_id == 3}) == 1
    assert [r.score for r in edge if r.doc_id == 4][0] > 0.3
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []
    none = toxicity.train(d.limit(0), l)
    assert all(r.score == pytest.approx(0.01) for r in toxicity.score(d, none).collect())
    assert plain_words(None) == []
