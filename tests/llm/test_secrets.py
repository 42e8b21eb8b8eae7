"""The Markov models decide: recall on random strings, silence on prose, rests of runs beside base spans."""

import random
import re
import string

import numpy as np
import pytest

from tidewheel.llm import secret_scan as S


@pytest.fixture(scope="module")
def model(spark):
    return S.train(S.labelled_samples(spark, 4000))


def test_held_out_samples(spark, model):
    rows = [(r.text, r.is_random) for r in S.labelled_samples(spark, 8000).collect()]
    held = [(t, y) for i, (t, y) in enumerate(rows) if i % 8000 >= 4000 and S.KEY_RUN.fullmatch(t)]
    hit = lambda t: bool(S.markov_spans(t, [], model))
    assert np.mean([hit(t) for t, y in held if y]) >= 0.95
    assert np.mean([hit(t) for t, y in held if not y]) <= 0.002


@pytest.mark.parametrize("signs, least", [(string.ascii_letters, 0.9), (string.ascii_letters + string.digits, 0.95), (string.ascii_lowercase + string.digits, 0.9)])
def test_random_keys(model, signs, least):
    rng = random.Random(3)
    keys = ["".join(rng.choice(signs) for _ in range(24)) for _ in range(400)]
    assert np.mean([bool(S.markov_spans(k, [], model)) for k in keys]) >= least


def test_silence(model):
    for text in ("Donaudampfschifffahrtsgesellschaft", "internationalization/localization-guidelines", "=" * 60, "-" * 200, "1234567890-1234567890", "anticonstitutionnellement", "MAX_CONNECTION_RETRY_COUNT", "2024-01-31-final-report-version"):
        assert S.markov_spans(text, [], model) == [], text


def test_rest_beside_base_spans(spark, model):
    key = "Zq8XvT3kLw9RbY2mNcJ7"
    text = "0123456789abcdef01234567" + key + " " + key
    spans = S.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), model=model).first().spans
    assert [(s.kind, s.start, s.end, s.is_base) for s in spans] == [("hex", 0, 24, True), ("markov", 24, 44, False), ("markov", 45, 65, False)]
    clean = S.redacted(spark.createDataFrame([(1, text)], "doc_id long, text string"), model=model).first().text
    assert key not in clean


def test_base_spans_by_plain_rules():
    rng = random.Random(9)
    bits = ["password", "Passwd=", "api_key : ", "token='", "secret\": \"", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeef", " ", ",", "xyz+/_.=-", "é", "\n", "TOKEN:"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert S.base_spans(text) == sorted(want), text


def test_edges(spark, model):
    rows = [(None, "z" * 500_000 + " token: abcdefgh"), (1, None), (1, ""), (1, ""), (2, "token: abcdefgh"), (2, "token: abcdefgh")]
    got = S.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans"), model=model).collect()
    assert sorted((r.doc_id or 0, len(r.spans)) for r in got) == [(0, 1), (1, 0), (1, 0), (1, 0), (2, 1), (2, 1)]
    assert S.scan(spark.createDataFrame([], "doc_id long, text string"), model=model).collect() == []


CONTEXTS = ("{}", "/home/people/projects/archive/{}/index", "http://host/static/images/gallery/{}/page", "access_identifier={}", "session_manager_{}_backup")


@pytest.mark.parametrize("context", CONTEXTS)
def test_random_keys_joined_to_ordinary_text_are_found(model, context):
    import random
    import string

    rng = random.Random(11)
    for n in (20, 24, 32, 40):
        found = 0
        for _ in range(100):
            key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
            text = context.format(key)
            at = text.index(key)
            base = S.base_spans(text)
            found += any(a <= at and e >= at + n for a, _, e in base + S.markov_spans(text, base, model))
        assert found >= 90, (context, n, found)


def test_paths_and_names_without_keys_have_no_spans(model):
    for text in ("/home/people/projects/archive/2024/index/settings_manager.backup", "http://host/static/images/gallery/landscape-overview/page", "access_identifier=development_environment", "international-classification-of-diseases"):
        assert S.markov_spans(text, S.base_spans(text), model) == []


def test_many_keys_of_a_very_long_run_are_found_in_one_pass(model):
    import random
    import string
    import time

    rng = random.Random(12)
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32)) for _ in range(2000)]
    text = "/projects/archive/documents/language/settings/library/collection/".join(["", *keys, ""])
    began = time.time()
    spans = S.markov_spans(text, [], model)
    assert time.time() - began < 20
    covered = np.zeros(len(text), bool)
    for a, _, e in spans:
        covered[a:e] = True
    assert sum(covered[text.index(k) : text.index(k) + 32].all() for k in keys[:200]) >= 195
