"""Fixed-interval cycles of daily series: weekday and trend taken out, a scan of periods, permutations, discovery control."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linear, seeded
from ..functions.linear import let
from ..functions.scalar import finite, text_seed
from ..scratch import kept
from .windows import KEY

# The catalogue of series, by id, and the column of a day that each reads.
CATALOGUE = {
    "sleep_start": "bed", "wake_time": "wake", "sleep_duration": "duration", "deep_share": "deep", "rem_share": "rem", "wake_share": "awake", "sleep_median_hr": "median_bpm",
    "sleep_low_hr": "low_bpm", "resting_hr": "resting_bpm", "hr_settling": "settling", "first90_disruption": "disruption",
}


def series_of(days: DataFrame, catalogue: dict[str, str] = CATALOGUE, min_n: int = 50) -> DataFrame:
    """(series, day, y, n): valid days of each person and catalogue entry with a finite value, for series of min_n or more."""
    named = days.where("valid").select("person", "day", *(F.col(c).cast("double").alias(k) for k, c in catalogue.items()))
    long = named.unpivot(["person", "day"], list(catalogue), "feature", "y").withColumn("y", finite(F.col("y"))).where("y IS NOT NULL")
    s = long.select(F.concat_ws("-", F.col("person").cast("string"), "feature").alias("series"), "day", "y")
    return s.withColumn("n", F.count("*").over(Window.partitionBy("series"))).where(F.col("n") >= min_n)


def core_series(members: DataFrame, published: DataFrame, ends: DataFrame, names: DataFrame, least_valid: int = 30, least_core: int = 5, least_rest: int = 8) -> DataFrame:
    """(series, day, y, n, person, window_end, cluster, pattern_id, core_days, emergence): for each shown pattern of the given windows, 1 on its core days, else 0.

    names: (person, window_end, cluster, pattern_id). A series is named by person, window and pattern id, which seed its shuffles.
    """
    valid = members.join(ends, KEY, "left_semi").select(*KEY, "day", F.col("cluster").alias("own"), "membership")
    valid = valid.withColumn("n", F.count("*").over(Window.partitionBy(*KEY))).where(F.col("n") >= least_valid)
    shown = published.where("shown").join(names.select(*KEY, "cluster", "pattern_id"), [*KEY, "cluster"]).select(*KEY, "cluster", "pattern_id", "core_days", "emergence")
    rows = valid.join(shown, KEY).where((F.col("core_days") >= least_core) & (F.col("n") - F.col("core_days") >= least_rest))
    y = ((F.col("own") == F.col("cluster")) & (F.col("membership") == "core")).cast("double")
    series = F.concat_ws("-", *(F.col(c).cast("string") for c in (*KEY, "pattern_id")))
    return rows.select(series.alias("series"), "day", y.alias("y"), "n", *KEY, "cluster", "pattern_id", "core_days", "emergence")


def with_span(series: DataFrame) -> DataFrame:
    """Rows with span, the days from the first to the last of a series."""
    w = Window.partitionBy("series")
    return series.withColumn("span", F.unix_date(F.max("day").over(w)) - F.unix_date(F.min("day").over(w)) + 1)


def with_halves(series: DataFrame) -> DataFrame:
    """Rows with half: 1 for the first floor(n / 2) days of a series, else 2."""
    at = F.row_number().over(Window.partitionBy("series").orderBy("day"))
    return series.withColumn("half", F.when(at <= F.floor(F.col("n") / 2), 1).otherwise(2))


def _baseline(ordinals: Column) -> Column:
    """The design of what any cycle is measured against: a constant, the trend from 0 to 1, and Monday to Saturday."""
    first, last = F.array_min(ordinals), F.array_max(ordinals)
    falls_on = lambda k: lambda o: (F.pmod(o + 4, F.lit(7)) == k).cast("double")  # noqa: E731  day 0 was a Thursday; Sunday is 0
    trend = F.transform(ordinals, lambda o: (o - first) / F.greatest(F.lit(1), last - first))
    return F.array(F.transform(ordinals, lambda o: F.lit(1.0)), trend, *(F.transform(ordinals, falls_on(k)) for k in range(1, 7)))


def left_over(rows: DataFrame, keys: list[str], lo: int, hi: int, cycles: float) -> DataFrame:
    """(keys, periods, values, left) of rows (keys, day, y, span): arrays of one row a key, whose days are one person's.

    periods: those of which the span holds enough cycles; a key without any has no row. values: by day. left: what the baseline leaves of the values,
    then of a sine, then of a cosine of each period, all from one elimination.
    """
    wave = lambda f: F.transform("periods", lambda p: F.transform("day", lambda o: f(o * (2 * math.pi) / p)))
    few = F.filter(F.sequence(F.lit(lo).cast("long"), F.lit(hi).cast("long")), lambda p: F.col("span") / p >= cycles)
    g = rows.groupBy(*keys).agg(F.max("span").alias("span"), F.array_sort(F.collect_list(F.struct(F.unix_date("day").alias("day"), F.col("y").cast("double").alias("y")))).alias("r"))
    g = g.select(*keys, few.alias("periods"), F.col("r.day").alias("day"), F.col("r.y").alias("y")).where(F.size("periods") > 0)
    return g.select(*keys, "periods", F.col("y").alias("values"), linear.ridge_residuals(_baseline(F.col("day")), F.concat(F.array("y"), wave(F.sin), wave(F.cos))).alias("left"))


def fit_periods(rows: DataFrame, keys: list[str], lo: int = 2, hi: int = 21, cycles: float = 4) -> DataFrame:
    """(keys, period, explained, sine, cosine) of rows (keys, day, y, span), for each period of which the span holds enough cycles.

    A sine and a cosine are fitted to what the baseline leaves of the values. Where it leaves nothing of a wave, as of one week, the wave explains nothing.
    """
    return _fitted(left_over(rows, keys, lo, hi, cycles), keys)


def _fitted(g: DataFrame, keys: list[str]) -> DataFrame:
    n = F.size("periods")
    each = F.transform("periods", lambda p, i: F.struct(p.alias("period"), F.element_at("left", i + 2).alias("s"), F.element_at("left", i + 2 + n).alias("c")))
    g = g.select(*keys, F.col("left")[0].alias("y"), F.explode(each).alias("w")).select(*keys, "y", "w.*")
    sums = {a + b: linear.dot(F.col(a), F.col(b)) for a, b in ("ss", "cc", "sc", "sy", "cy", "yy")}
    return explained_share(g.select(*keys, "period", *(v.alias(k) for k, v in sums.items()))).select(*keys, "period", "explained", "sine", "cosine")


def explained_share(sums: DataFrame) -> DataFrame:
    """sums, of products of the waves s and c and values y, with sine, cosine and explained, the share of the values' squares."""
    det = F.greatest(F.lit(1e-9), F.col("ss") * F.col("cc") - F.col("sc") * F.col("sc"))
    g = sums.withColumns({"sine": (F.col("sy") * F.col("cc") - F.col("cy") * F.col("sc")) / det, "cosine": (F.col("cy") * F.col("ss") - F.col("sy") * F.col("sc")) / det})
    return g.withColumn("explained", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("sy") * F.col("sine") + F.col("cy") * F.col("cosine")) / F.greatest(F.lit(1e-9), F.col("yy"))))


def scan(series: DataFrame, lo: int = 2, hi: int = 21, cycles: float = 4) -> DataFrame:
    """(series, period, explained, amplitude, phase) for each period of which the series holds enough cycles."""
    g = fit_periods(with_span(series), ["series"], lo, hi, cycles)
    return g.select("series", "period", "explained", F.sqrt(F.col("sine") ** 2 + F.col("cosine") ** 2).alias("amplitude"), F.atan2("cosine", "sine").alias("phase"))


def best_period(scanned: DataFrame, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """The period that explains most of each series; the shorter of equals. Shares that differ only behind nine digits are equal."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("explained", 9)), "period")
    return scanned.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def split(series: DataFrame, selected: DataFrame, lo: int = 2, hi: int = 21, cycles: float = 4) -> DataFrame:
    """(series, first_explained, second_explained, first_best, second_best, agreement): both halves at the selected period and their own best ones.

    selected: (series, period). agreement is the cosine between both halves' coefficients; 0 where one has none. Halves try the
    periods of the whole series.
    """
    halves = fit_periods(with_span(with_halves(series)), ["series", "half"], lo, hi, cycles)
    own = best_period(halves, ("series", "half")).select("series", "half", F.col("period").alias("best"))
    at = halves.join(selected.select("series", "period"), ["series", "period"]).join(own, ["series", "half"])
    pick = lambda c, h: F.max(F.when(F.col("half") == h, F.col(c)))
    g = at.groupBy("series").agg(*(pick(c, h).alias(f"{c}{h}") for c in ("explained", "best", "sine", "cosine") for h in (1, 2)))
    dot = F.col("sine1") * F.col("sine2") + F.col("cosine1") * F.col("cosine2")
    size = F.sqrt((F.col("sine1") ** 2 + F.col("cosine1") ** 2) * (F.col("sine2") ** 2 + F.col("cosine2") ** 2))
    return g.select("series", F.col("explained1").alias("first_explained"), F.col("explained2").alias("second_explained"), F.col("best1").alias("first_best"), F.col("best2").alias("second_best"),
                    F.when(size > 1e-9, dot / size).otherwise(0.0).alias("agreement"))


def publishable_features(tests: DataFrame) -> DataFrame:
    """tests (series, period, explained, p, q, columns of split()) with split_stable and publishable."""
    near = lambda c: F.abs(F.col(c) - F.col("period")) <= 1
    stable = (F.col("first_explained") >= 0.04) & (F.col("second_explained") >= 0.04) & near("first_best") & near("second_best") & (F.col("agreement") > 0)
    return tests.withColumn("split_stable", stable).withColumn("publishable", F.col("split_stable") & (F.col("q") <= 0.1) & (F.col("explained") >= 0.08))


def publishable_patterns(tests: DataFrame) -> DataFrame:
    """tests (series, person, pattern_id, period, explained, p, q) with replicated and publishable.

    replicated: another window of the person has the same pattern id at a period within one day, p at most 0.1.
    """
    other = tests.where("p <= 0.1").select("person", "pattern_id", F.col("series").alias("other"), F.explode(F.sequence(F.col("period") - 1, F.col("period") + 1)).alias("period"))
    found = tests.join(other, ["person", "pattern_id", "period"]).where("other <> series").select("series").distinct().withColumn("replicated", F.lit(True))
    rows = tests.join(found, "series", "left").withColumn("replicated", F.coalesce("replicated", F.lit(False)))
    return rows.withColumn("publishable", (F.col("q") <= 0.1) & (F.col("explained") >= 0.1) & F.col("replicated"))


def counters(tests: DataFrame) -> DataFrame:
    """One row: tested, nominal (p <= 0.05), discovered (q <= 0.1), publishable series."""
    return tests.agg(F.count("*").alias("tested"), F.count_if(F.col("p") <= 0.05).alias("nominal"), F.count_if(F.col("q") <= 0.1).alias("discovered"), F.count_if("publishable").alias("publishable"))


def strongest(tests: DataFrame, n: int = 20) -> DataFrame:
    """The n tests of least p; of equals, those that explain more."""
    return tests.orderBy("p", F.desc("explained"), "series").limit(n)


def moments(series: DataFrame) -> DataFrame:
    """(series, mean, deviation): mean and population deviation."""
    return series.groupBy("series").agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("deviation"))


def discovery_control(tests: DataFrame, p: str = "p", family: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg q of each test: the running minimum of p m / rank from the largest p down, by family.

    Tests are sorted over range partitions by (family, p), so no family meets in one task. Ranks are a place inside a
    partition plus the counts of the ones before; running minima are those of the partition's rest and of later ones. Both come from a
    row a partition and family. Ties of p share what the last of them gets.
    """
    keys = family or []
    fam = F.xxhash64(*keys) if keys else F.lit(0).cast("long")
    ordered = tests.withColumns({"_f": fam, "_p": F.col(p)}).repartitionByRange("_f", "_p")
    rows = kept(ordered.withColumn("_part", F.spark_partition_id()), "tests")
    sizes = rows.groupBy("_f", "_part").agg(F.count("*").alias("_n"))
    by_part = Window.partitionBy("_f").orderBy("_part")
    before = sizes.select("_f", "_part", (F.sum("_n").over(by_part) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("_f")).alias("_m"))
    inside = Window.partitionBy("_f", "_part").orderBy("_p")
    ranked = rows.join(before, ["_f", "_part"]).withColumn("_x", F.col("_p") * F.col("_m") / (F.col("_before") + F.row_number().over(inside)))
    rest = F.min("_x").over(Window.partitionBy("_f", "_part").orderBy(F.desc("_p")))  # a range frame, so ties share
    least = ranked.groupBy("_f", "_part").agg(F.min("_x").alias("_least"))
    later = least.select("_f", "_part", F.min("_least").over(by_part.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    out = ranked.withColumn("_rest", rest).join(later, ["_f", "_part"])
    return out.withColumn("q", F.least(F.lit(1.0), F.col("_rest"), F.coalesce("_later", F.lit(1.0)))).select(*tests.columns, "q")


def _uniforms(seed: int, n: int) -> np.ndarray:
    """The first n values of the public mulberry32 generator: its state only counts up, so they are made at once."""
    with np.errstate(over="ignore"):
        state = np.uint32(seed) + np.arange(1, n + 1, dtype=np.uint32) * np.uint32(0x6D2B79F5)
        t = (state ^ (state >> np.uint32(15))) * (state | np.uint32(1))
        t = t ^ (t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61)))
    return (t ^ (t >> np.uint32(14))) / 4294967296.0


def block_orders(n: int, block: int, runs: int, seed: int, first: int = 0) -> np.ndarray:
    """(runs, n) positions: blocks of neighbours shuffled by exchanges from the last one down, runs, from number `first` on, after one another in one stream."""
    k = -(-n // block)
    each = max(k - 1, 0)
    u = _uniforms(seed + first * each * seeded.STEP & 0xFFFFFFFF, runs * each).reshape(runs, -1)
    order = np.tile(np.arange(k), (runs, 1))
    every = np.arange(runs)
    for step, last in enumerate(range(k - 1, 0, -1)):
        other = (u[:, step] * (last + 1)).astype(np.int64)
        order[every, last], order[every, other] = order[every, other], order[every, last].copy()
    places = np.full(k * block, -1)
    places[:n] = np.arange(n)
    flat = places.reshape(k, block)[order].reshape(runs, -1)
    return flat[flat >= 0].reshape(runs, n)


def _beaten(block: int):
    """For each row (series, seed, first, runs, least, left) how many of its runs explain `least` or more at some period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for row in b.to_pylist():
                left = np.array(row["left"])
                m = len(left) // 2
                r, s, c = left[0], left[1 : 1 + m], left[1 + m :]
                ss, cc, sc = (s * s).sum(axis=1), (c * c).sum(axis=1), (s * c).sum(axis=1)
                shuffled = r[block_orders(len(r), block, row["runs"], row["seed"], row["first"])]
                sy, cy = shuffled @ s.T, shuffled @ c.T
                share = np.clip((sy * (sy * cc - cy * sc) + cy * (cy * ss - sy * sc)) / np.maximum(1e-9, ss * cc - sc * sc) / max(1e-9, float(r @ r)), 0, 1)
                found.append(int((share.max(axis=1) >= row["least"] - 1e-12).sum()))
            yield pa.RecordBatch.from_arrays([b.column("series"), pa.array(found, pa.int64())], ["series", "beaten"])

    return run


def permutation_p(series: DataFrame, lo: int = 2, hi: int = 21, cycles: float = 4, runs: int = 5000, block: int = 3, parts: int = 8) -> DataFrame:
    """(series, n, period, explained, p, amplitude, standardized): the greatest explained share over all periods against
    shuffles of the residuals in blocks of three.

    Shuffles are seeded by the series' name. Runs are cut into parts, each of which starts at its own place of the stream and is worked out by
    whatever task it falls to; the counts of the parts add up to the same p for any number of parts.
    """
    g = kept(left_over(with_span(series), ["series"], lo, hi, cycles), "left")
    seen = best_period(_fitted(g, ["series"]))
    each = -(-runs // parts)
    first = F.explode(F.sequence(F.lit(0), F.lit(runs - 1), F.lit(each))).alias("first")
    shared = g.join(seen.select("series", F.col("explained").alias("least")), "series").select("series", text_seed(F.col("series")).alias("seed"), "least", "left", first)
    shared = shared.withColumn("runs", F.least(F.lit(each), runs - F.col("first"))).repartition("series", "first")
    beaten = shared.mapInArrow(_beaten(block), "series string, beaten long").groupBy("series").agg(F.sum("beaten").alias("beaten"))
    mean = linear.total(F.col("values")) / F.size("values")
    deviation = F.sqrt(let(mean, lambda m: linear.total(F.transform("values", lambda v: (v - m) * (v - m)))) / F.size("values"))
    size = F.sqrt(F.col("sine") ** 2 + F.col("cosine") ** 2)
    out = seen.join(g.select("series", F.size("values").cast("long").alias("n"), deviation.alias("deviation")), "series").join(beaten, "series")
    return out.select("series", "n", "period", "explained", ((F.col("beaten") + 1) / (runs + 1)).alias("p"), size.alias("amplitude"), (size / F.greatest(F.lit(1e-9), F.col("deviation"))).alias("standardized"))
