"""The rhythm operators: against DuckDB on the smallest tables, and on planted data."""

import decimal
import glob
import os

import duckdb
import numpy as np
import pytest

from tidewheel.operators import clustering
from tidewheel.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(value):
    return round(value, 9) + 0.0 if isinstance(value, float) else float(value) if isinstance(value, decimal.Decimal) else value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", ["win1_rolling_counts", "prj7_features", "mem1_membership", "emg1_patterns", "join1_samples_in_nights", "per3_scan", "per5_split", "fn_labels", "fn20_text_seed", "win10_discovery_control", "res5_resonance", "prj10_pattern_rows", "viz5_overlaps", "set2_united", "join17_profile", "agg8_first_minutes"])
def test_agrees_with_sql(spark, duck, name):
    df, found = QUERIES[name](spark, DATA), duck.execute(ORACLES[name])
    got = rows(df.columns, df.collect())
    want = rows([c[0] for c in found.description], found.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert got[1] == want[1]


def blobs(centres, n=14, seed=3):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(c, 0.08, (n, 9)) for c in centres]), np.repeat(range(len(centres)), n)


def test_two_blobs_are_accepted():
    x, truth = blobs([np.zeros(9), np.full(9, 2.0)])
    dates = [f"2024-01-{i + 1:02d}" for i in range(len(x))]
    labels, _, _ = clustering.best_of(x, dates, 2)
    assert clustering.adjusted_rand(labels, truth) == 1
    assert clustering.propose(x, dates)[1] >= 2


def test_few_days_make_one_cluster():
    x, _ = blobs([np.zeros(9)], 7)
    assert clustering.propose(x, [str(i) for i in range(7)])[1] == 1


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
