"""Silhouettes and agreement against the clustering's own; as-of interpolation; clauses, leads and their words."""

from __future__ import annotations

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import scalar
from tidewheel.functions.scalar import bpm_range
from tidewheel.operators import asof, cluster_quality, clustering, insights
from tidewheel.operators.windows import FEATURES

DAY = dt.date(2024, 3, 1)


def labelled(spark, windows):
    """windows: name to (rows of features, labels)."""
    rows = [(p, DAY, DAY + dt.timedelta(i), int(c), int(i) % 3, *map(float, v)) for p, (x, labels) in windows.items() for i, (v, c) in enumerate(zip(x, labels, strict=True))]
    return spark.createDataFrame(rows, "person string, window_end date, day date, cluster int, other int, " + ", ".join(f"{f} double" for f in FEATURES))


def test_silhouette_and_agreement_equal_those_of_the_clustering(spark):
    rng = np.random.default_rng(3)
    windows = {f"p{k}": (rng.normal(0, 1, (n, 9)) + np.arange(n)[:, None] % k, np.arange(n) % k) for n, k in ((42, 2), (30, 3), (17, 4))}
    windows["alone"] = (rng.normal(0, 1, (6, 9)), np.array([0, 0, 0, 0, 0, 1]))
    windows["equal"] = (np.ones((5, 9)), np.array([0, 0, 1, 1, 1]))
    df = labelled(spark, windows | {"one": (rng.normal(0, 1, (4, 9)), np.zeros(4, int)), "day": (np.ones((1, 9)), np.zeros(1, int))}).cache()
    got = {r.person: r.silhouette for r in cluster_quality.silhouette(df).collect()}
    assert got.pop("one") is None and got.pop("day") is None
    assert got == {p: pytest.approx(clustering.silhouette(x, c), abs=1e-9) for p, (x, c) in windows.items()}
    same = {r.person: r.agreement for r in cluster_quality.agreement(df, "cluster", "other").collect()}
    assert same["day"] == 1
    for p, (x, c) in windows.items():
        assert same[p] == pytest.approx(clustering.adjusted_rand(c, np.arange(len(x)) % 3), abs=1e-9)
        assert cluster_quality.agreement(df.where(F.col("person") == p), "cluster", "cluster").first().agreement == 1


def test_values_between_neighbours_and_beyond_the_ends(spark):
    known = [("a", 1.0, 10.0), ("a", 3.0, 30.0), ("a", 3.0, 20.0), ("a", 7.0, 0.0), ("a", None, 5.0), ("a", 5.0, None), ("b", 2.0, 4.0)]
    asked = [("a", 0.0, 1), ("a", 1.0, 2), ("a", 2.0, 3), ("a", 3.0, 4), ("a", 5.0, 5), ("a", 9.0, 6), ("a", 5.0, 7), ("b", 1.0, 8), ("none", 1.0, 9)]
    got = asof.interpolated(spark.createDataFrame(asked, "k string, at double, value_of int"), spark.createDataFrame(known, "k string, at double, value double"), ["k"])
    assert {r.value_of: r.value for r in got.collect()} == {1: 10, 2: 10, 3: 15, 4: 20, 5: 15, 6: 0, 7: 15, 8: 4, 9: 0}


def test_neighbours_come_from_growing_frames_and_agree_with_numpy(spark):
    rng = np.random.default_rng(4)
    at, asked = np.sort(rng.integers(0, 500, 200)), rng.integers(-20, 520, 150)
    known = [("k", float(a), float(v)) for a, v in zip(at, rng.random(200), strict=True)]
    df = asof.interpolated(spark.createDataFrame([("k", float(a), i) for i, a in enumerate(asked.tolist())], "k string, at double, i int"), spark.createDataFrame(known, "k string, at double, value double"), ["k"])
    assert "unboundedfollowing" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r.i: r.value for r in df.collect()}
    for i, t in enumerate(asked.tolist()):
        left, right = max(((a, v) for _, a, v in known if a < t), default=None), min(((a, v) for _, a, v in known if a >= t), default=None)
        mix = (t - left[0]) / (right[0] - left[0]) if left and right else 0
        assert got[i] == pytest.approx(left[1] * (1 - mix) + right[1] * mix if left and right else (left or right)[1], abs=1e-12)


def nights(spark, high):
    """14 work nights, six of the pattern, which show both signals; `high` of those stand high in noise."""
    start = dt.date(2024, 1, 1)
    days = [d for d in (start + dt.timedelta(i) for i in range(30)) if d.weekday() < 5][:14]
    end = days[-1]
    rows = [("p", end, d, True, 90.0 if i < 6 else 20.0, 8.0 if i < 6 else 3.0, 9.0 if i < high else (1.0 if i >= 6 else None), 0.0) for i, d in enumerate(days)]
    windowed = spark.createDataFrame(rows, "person string, window_end date, day date, valid boolean, settling double, disruption double, noise double, still double")
    members = spark.createDataFrame([("p", end, d, 0, "core" if i < 6 else "boundary") for i, d in enumerate(days)], "person string, window_end date, day date, cluster int, membership string")
    return windowed, members


@pytest.mark.parametrize(("high", "expected"), [(6, True), (4, True), (3, False)])
def test_a_clause_needs_values_on_most_nights_and_a_high_median(spark, high, expected):
    row = insights.signals(*nights(spark, high), measures=("noise", "still")).where("chosen").first()
    assert (row.scope, row.support, row.late) == ("work", 6, True)
    assert row.high_noise is expected
    assert row.high_still is True
    assert row.limited is not expected


def test_leads_take_the_insight_then_the_strongest_association(spark):
    windowed, members = nights(spark, 6)
    end = members.first().window_end
    columns = "person string, window_end date, cluster int, definition string, source string, a long, b long, c long, comparison long, confidence double, strength double, shown boolean"
    found = spark.createDataFrame([("p", end, 0, "before_inferred_work_day", "calendar", 4, 1, 1, 8, 0.9, 0.9, True), ("p", end, 1, "alcohol", "food", 3, 2, 1, 7, 0.5, 0.5, True), ("p", end, 1, "late_dinner", "food", 3, 2, 1, 7, 0.5, 0.6, True), ("p", end, 2, "alcohol", "food", 3, 2, 1, 7, 0.5, 0.5, False)], columns)
    own = insights.with_calendar(insights.signals(windowed, members, ("noise",)), found)
    row = own.first()
    assert (row.calendar_id, row.inferred, row.adjusted_for) == ("before_inferred_work_day", True, "inferred_rest_day")
    patterns = spark.createDataFrame([("p", end, k) for k in range(3)], "person string, window_end date, cluster int")
    got = {r.cluster: r for r in insights.leads(patterns, own, found, {"noise": "noise"}).collect()}
    assert got[0].id == "signals_work"
    assert got[0].statement == "6 of 6 inferred work nights show both signals; the heart settles 70 minutes or more later, with 5 interruptions more. noise is high as well. Mostly before inferred work days."
    assert (got[1].id, got[1].statement) == ("late_dinner", "More often with late dinner: 3 of 5 nights, else 1 of 7.")
    assert got[2].id is None


def test_bpm_ranges(spark):
    rows = spark.createDataFrame([(0, 50.0, 60.0), (None, None, None), (3, 49.5, 50.4), (3, 49.4, 55.5)], "n int, low double, high double")
    assert [r[0] for r in rows.select(bpm_range(F.col("n"), F.col("low"), F.col("high"))).collect()] == ["not enough data", "not enough data", "50 bpm", "49–56 bpm"]


def test_halves_are_rounded_after_scaling(spark):
    x = [7.33125 * 0.24374999999999997, 1.7869921874999998, -1.7869921874999998, 0.1234567894, 2.5, -0.0000000005, None, float("inf")]
    got = [r.y for r in spark.createDataFrame([(v,) for v in x], "x double").select(scalar.rounded(F.col("x"), 9).alias("y")).collect()]
    duck = [duckdb.execute("SELECT round(?::DOUBLE, 9)", [v]).fetchone()[0] for v in x]
    assert got == duck and got[1] == 1.786992188
