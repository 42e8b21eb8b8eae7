"""Each stage of the pipeline on nulls, empties, repeats, one id with two texts, clashing columns and an empty table."""

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root long, label string"
LONG = " ".join(f"item{i} und die" for i in range(20_000))
PLAIN = " ".join(f"the house of day {i} and there was not a light in it" for i in range(6))


@pytest.fixture(scope="module")
def rows(spark):
    data = [(None, PLAIN), (1, PLAIN), (1, PLAIN), (2, PLAIN), (3, None), (4, ""), (5, LONG), (6, LONG + " x"), (7, PLAIN), (7, "another text of the same id with enough words in it to stand alone")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x") for i, t in data], SCHEMA)


def ids(df):
    return sorted((-1 if r.doc_id is None else r.doc_id) for r in df.select("doc_id").collect())


def test_near_copies(spark, rows):
    out = corpus_pipeline.near_copies(spark, rows, "")
    assert out.columns == rows.columns
    assert ids(out) == [-1, 1, 3, 4, 5, 7]
    assert [r.text[:7] for r in out.where("doc_id = 7").collect()] == ["another"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_empty_and_odd_tables(spark, rows, name, stage):
    sf = "/root/testdata/sf0.001"
    assert stage(spark, rows.limit(0), sf).collect() == []
    out = stage(spark, rows, sf)
    if name in ("decontaminate", "secret_scan"):
        assert ids(out) == ids(rows)
    if name == "packing":
        assert set(ids(out)) == set(ids(rows))
    else:
        assert out.columns == rows.columns
    out.collect()
