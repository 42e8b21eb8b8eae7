"""Cycles: the solver as columns, the ridge, seeded shuffles as columns, permutations in parts."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import linear, seeded
from tidewheel.functions.scalar import text_seed
from tidewheel.operators import clustering, periodicity

MATRICES = "m array<array<double>>, r array<array<double>>"


@pytest.mark.parametrize("n", [1, 3, 8])
def test_solver_equals_numpy_with_row_exchanges_and_many_right_sides(spark, n):
    rng = np.random.default_rng(n)
    m, r = rng.normal(0, 1, (n, n)), rng.normal(0, 1, (n, 4))
    if n > 1:
        m[0, 0] = 0
    got = spark.createDataFrame([(m.tolist(), r.tolist())], MATRICES).select(linear.solve(F.col("m"), F.col("r"))).first()[0]
    assert np.allclose(got, np.linalg.solve(m, r), atol=1e-10)


def test_solver_of_nothing_and_of_a_singular_matrix(spark):
    rows = spark.createDataFrame([([], []), ([[1.0, 1.0], [1.0, 1.0]], [[1.0], [1.0]])], MATRICES).select(linear.solve(F.col("m"), F.col("r"))).collect()
    assert rows[0][0] == []
    assert rows[1][0] == [[1.0], [0.0]]


def series(spark, days, values, name="s"):
    first = dt.date(2024, 1, 1)
    return spark.createDataFrame([(name, first + dt.timedelta(int(d)), float(v), len(days)) for d, v in zip(days, values, strict=True)], "series string, day date, y double, n int")


def plain_fit(days, values, period):
    """The least squares of the fit with its ridge, by numpy."""
    o = np.asarray(days, float) + (dt.date(2024, 1, 1) - dt.date(1970, 1, 1)).days
    week = (o + 4) % 7
    x = np.column_stack([np.ones(len(o)), (o - o.min()) / max(1, o.max() - o.min()), *((week == k).astype(float) for k in range(1, 7))])
    left = lambda v: v - x @ np.linalg.solve(x.T @ x + 1e-8 * np.eye(8), x.T @ v)
    y, s, c = (left(np.asarray(v, float)) for v in (values, np.sin(2 * np.pi * o / period), np.cos(2 * np.pi * o / period)))
    det = max(1e-9, (s @ s) * (c @ c) - (s @ c) ** 2)
    a, b = ((s @ y) * (c @ c) - (c @ y) * (s @ c)) / det, ((c @ y) * (s @ s) - (s @ y) * (s @ c)) / det
    return min(1.0, max(0.0, (s @ y) * a + (c @ y) * b) / max(1e-9, y @ y))


def test_every_period_has_a_fit_whole_weeks_too(spark):
    rng = np.random.default_rng(5)
    days = np.sort(rng.choice(130, 100, replace=False))
    values = np.sin(2 * np.pi * days / 14) + 0.3 * rng.normal(0, 1, 100) + (days % 7 == 2) * 2 + days / 40
    got = {r.period: r.explained for r in periodicity.scan(series(spark, days, values)).collect()}
    assert sorted(got) == list(range(2, 22))
    for period, explained in got.items():
        assert explained == pytest.approx(plain_fit(days, values, period), abs=1e-8)
    assert got[7] == pytest.approx(0, abs=1e-8)
    assert max(got, key=got.get) == 14


def test_a_series_without_one_weekday_and_one_too_short_for_any_period(spark):
    days = [d for d in range(100) if d % 7 != 6]
    values = np.cos(2 * np.pi * np.array(days) / 5)
    both = series(spark, days, values).union(series(spark, [0, 1, 2], [1, 2, 3], "short"))
    got = periodicity.scan(both).collect()
    assert {r.series for r in got} == {"s"}
    assert {r.period: r.explained for r in got}[5] == pytest.approx(plain_fit(days, values, 5), abs=1e-6)


def test_values_of_the_generator_by_place(spark):
    for seed in (0, 1, 77, 2**31, 2**32 - 1):
        plain = clustering.Uniforms(seed)
        want = [plain() for _ in range(60)]
        got = spark.range(1, 61).select("id", seeded.uniform(F.lit(seed), F.col("id")).alias("v")).orderBy("id").collect()
        assert [r.v for r in got] == want


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 42])
def test_block_orders_as_columns_equal_those_of_numpy(spark, n):
    want = periodicity.block_orders(n, 3, 6, 991).tolist()
    got = spark.range(6).select("id", seeded.block_order(F.lit(n), 3, F.lit(991), F.col("id")).alias("o")).orderBy("id").collect()
    assert [r.o for r in got] == want
    assert periodicity.block_orders(n, 3, 2, 991, first=4).tolist() == want[4:]


def test_p_does_not_depend_on_the_parts_of_the_runs(spark):
    rng = np.random.default_rng(8)
    days = np.arange(80)
    both = series(spark, days, np.sin(2 * np.pi * days / 5) + rng.normal(0, 1.6, 80), "a-x").union(series(spark, days, rng.normal(0, 1, 80), "a-y")).cache()
    by_parts = [sorted(map(tuple, periodicity.permutation_p(both, runs=301, parts=k).collect())) for k in (1, 8)]
    assert by_parts[0] == by_parts[1]
    assert len(by_parts[0]) == 2
    seed = spark.range(1).select(text_seed(F.lit("a-x"))).first()[0]
    assert seed == clustering.seed_of(["a-x"], 0)
