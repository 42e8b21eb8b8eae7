"""The class model against a plain recount, on seen, rare and new words; two models in one session; edges."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tidewheel.llm import class_lm
from tidewheel.llm.common import words_of, written


def texts():
    rng = random.Random(1)
    kinds = [[f"{c}{i}" for i in range(30)] for c in "abc"]
    return [" ".join(rng.choice(kinds[i % 3]) for i in range(rng.randrange(1, 40))) for _ in range(300)]


def model_of(spark, docs, **more):
    t = spark.createDataFrame([(x,) for x in docs], "text string")
    counts = written(class_lm.count_words(t), "words")
    return class_lm.train(t, counts, **more), counts


def plain(text, model, counts):
    """Class transitions and emissions one word at a time; words outside the head by their own count."""
    place = {w: i for i, w in enumerate(model["words"])}
    before, total = model["end_class"], 0.0
    for w in [*words_of(text), class_lm.END]:
        i = place.get(w, len(place))
        c = int(model["class"][i])
        total += model["transition"][before, c]
        total += model["emission"][i] if w in place else math.log10((counts.get(w, 0) + 0.5) / model["rare_norm"])
        before = c
    return total


@pytest.mark.parametrize("head, clustered", [(1000, 1000), (60, 20), (1000, 15)])
def test_score_as_recounted(spark, head, clustered):
    train = texts()
    model, counts = model_of(spark, train, head=head, clustered=clustered)
    n = Counter(w for t in train for w in [*words_of(t), class_lm.END])
    docs = [*enumerate(train[:20]), (100, "new a1 b2 new2"), (101, ""), (102, None), (None, "a1"), (100, "new a1 b2 new2")]
    got = class_lm.score(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS row"), model, counts).collect()
    key = lambda i, s: (-1 if i is None else i, round(s, 6))
    assert sorted(key(r.doc_id, r.score) for r in got) == sorted(key(i, plain(t, model, n)) for i, t in docs)
    v, total = len(n), sum(n.values())
    base = lambda t: sum(math.log10((n.get(w, 0) + 0.5) / (total + 0.5 * (v + 1))) for w in [*words_of(t), class_lm.END])
    assert sorted(key(r.doc_id, r.base_score) for r in got) == sorted(key(i, base(t)) for i, t in docs)
    # Emissions of a class and of all words that share the last one sum to one.
    c, e = model["class"][:-1], model["emission"][:-1]
    assert np.bincount(c, weights=10.0 ** e)[np.unique(c)] == pytest.approx(1.0)
    assert (10.0 ** model["transition"]).sum(axis=1) == pytest.approx(1.0)


def test_words_outside_exchange_find_their_class(spark):
    model, _ = model_of(spark, texts(), clustered=45)
    of = {w.decode(): int(c) for w, c in zip(model["words"], model["class"], strict=False)}
    share = [Counter(of[f"{c}{i}"] for i in range(30) if f"{c}{i}" in of) for c in "abc"]
    every = set().union(*share)
    assert sum(max(s[k] for s in share) for k in every) >= 0.9 * sum(map(len, [[*s.elements()] for s in share]))


def test_two_models_in_one_session(spark):
    first, n1 = model_of(spark, ["a b c"] * 5)
    second, n2 = model_of(spark, ["c c c d"] * 50)
    docs = spark.createDataFrame([(1, "a b c"), (2, "c d")], "doc_id long, text string")
    score = lambda m, n: {r.doc_id: r.score for r in class_lm.score(docs, m, n).collect()}
    a, b, again = score(first, n1), score(second, n2), score(first, n1)
    assert a == again and a != b


def test_no_training_text_and_a_long_one(spark):
    model, counts = model_of(spark, [])
    docs = spark.createDataFrame([(1, "a " * 300_000), (2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in class_lm.score(docs, model, counts).collect()}
    assert got == {1: (300_001, 0, 0.0, 0.0), 2: (1, 0, 0.0, 0.0)}
    assert class_lm.score(docs.limit(0), model, counts).collect() == []
