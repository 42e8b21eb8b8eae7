"""Small dense linear algebra as columns: vectors are arrays of doubles, matrices arrays of such rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A pivot smaller than this counts as this.
LEAST_PIVOT = 1e-9


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(xs: Column, ys: Column) -> Column:
    return total(F.zip_with(xs, ys, lambda x, y: x * y))


def _pivot(m: Column, k: Column) -> Column:
    """The row, from k on, with the largest absolute value in column k; the first of equals."""
    rows = F.transform(m, lambda row, r: F.struct(F.when(r >= k, F.abs(row[k])).otherwise(-1.0).alias("size"), (-r).alias("at")))
    return -F.array_max(rows)["at"]


def _swapped(m: Column, k: Column, p: Column) -> Column:
    return F.transform(m, lambda row, r: F.when(r == k, m[p]).when(r == p, m[k]).otherwise(row))


def _cleared(m: Column, k: Column) -> Column:
    """m with row k divided by its pivot and taken off the others, so that column k is a unit vector."""
    whole = let(m[k][k], lambda v: F.transform(m[k], lambda x: x / F.when(F.abs(v) < LEAST_PIVOT, F.lit(LEAST_PIVOT)).otherwise(v)))
    return let(whole, lambda own: F.transform(m, lambda row, r: F.when(r == k, own).otherwise(F.zip_with(row, own, lambda x, y: x - row[k] * y))))


def solve(matrix: Column, right: Column) -> Column:
    """X of matrix X = right, by Gauss-Jordan elimination with row exchanges; right has a column for each system.

    Any number of systems share one elimination. A singular matrix gives what LEAST_PIVOT makes of it, an empty one no rows.
    """
    both = F.zip_with(matrix, right, lambda a, b: F.struct(F.size(a).alias("n"), F.concat(a, b).alias("row")))
    step = lambda m, k: let(_swapped(m, k, _pivot(m, k)), lambda s: _cleared(s, k))
    done = lambda b: F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), b["row"], step)
    out = lambda b: let(b[0]["n"], lambda n: F.transform(done(b), lambda row: F.slice(row, n + 1, F.size(row) - n)))
    return let(both, lambda b: F.when(F.size(b) > 0, out(b)).otherwise(F.array().cast("array<array<double>>")))


def ridge_residuals(design: Column, values: Column, ridge: float = 1e-8) -> Column:
    """What each of the series in `values` keeps when the columns of `design` are fitted to it by least squares, `ridge` on the diagonal.

    design and values: arrays of series of one length.
    """

    def left(x: Column, vs: Column) -> Column:
        gram = F.transform(x, lambda a, i: F.transform(x, lambda b, j: dot(a, b) + F.when(i == j, F.lit(ridge)).otherwise(0.0)))
        cross = F.transform(x, lambda a: F.transform(vs, lambda v: dot(a, v)))
        taken = lambda v, j, beta: F.aggregate(F.arrays_zip(x.alias("x"), beta.alias("b")), v, lambda acc, t: F.zip_with(acc, t["x"], lambda p, q: p - q * t["b"][j]))
        return let(solve(gram, cross), lambda beta: F.transform(vs, lambda v, j: taken(v, j, beta)))

    return let(design, lambda x: let(values, lambda vs: left(x, vs)))
