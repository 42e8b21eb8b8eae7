"""Windows of at most 42 calendar days: days by window end, feature scales, additional sleep, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp, monday

SPAN = 42
KEY = ["person", "window_end"]
# Metric, least scale, weight.
METRICS = (("median_bpm", 3.0, 0.45), ("low_bpm", 3.0, 0.30), ("settling", 8.0, 0.35), ("resting_bpm", 2.5, 0.35), ("disruption", 2.0, 0.28))
# Clock feature, centre, scale.
CLOCK = (("bed", 24.3, 1.35), ("wake", 32.0, 1.7), ("duration", 7.6, 1.2))
FEATURES = [f"f{i}" for i in range(9)]


def rolling_counts(days: DataFrame, span: int = SPAN) -> DataFrame:
    """Days and valid days of the window that ends with each day, by a range frame over the day's number."""
    w = Window.partitionBy("person").orderBy(F.unix_date("day")).rangeBetween(1 - span, 0)
    return days.select("person", F.col("day").alias("window_end"), F.count("*").over(w).alias("available"), F.count_if("valid").over(w).alias("valid_days"))


def window_days(days: DataFrame, span: int = SPAN, ends: DataFrame | None = None) -> DataFrame:
    """Each day once for each window that it is in: ends are days of the person's calendar, or those given as (person, window_end).

    A day meets its at most `span` ends by an equality join, so nothing is compared by range.
    """
    if ends is None:
        ends = days.select("person", F.col("day").alias("window_end"))
    spread = days.withColumn("window_end", F.explode(F.sequence(F.col("day"), F.date_add("day", span - 1))))
    return spread.join(ends, KEY)


def scales(windowed: DataFrame) -> DataFrame:
    """Centre and scale of each metric in each window: null unless max(6, half of the valid days) have a value."""
    valid = windowed.where("valid")
    aggs = [F.count("*").alias("n")]
    for m, _, _ in METRICS:
        aggs += [F.percentile(m, F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8))).alias(f"q_{m}"), F.count(m).alias(f"n_{m}")]
    g = valid.groupBy(*KEY).agg(*aggs)
    out = []
    for m, floor, _ in METRICS:
        enough = F.col(f"n_{m}") >= F.greatest(F.lit(6), F.ceil(F.col("n") * 0.5))
        q = F.col(f"q_{m}")
        out += [F.when(enough, q[1]).alias(f"{m}_center"), F.when(enough, F.greatest(F.lit(floor), (q[2] - q[0]) / 1.28)).alias(f"{m}_scale")]
    return g.select(*KEY, F.col("n").alias("valid_days"), *out)


def extra_sleep(windowed: DataFrame) -> DataFrame:
    """Naps of each window: count, share, weeks, and whether they can be a candidate's trait or define one."""
    g = windowed.where("valid").groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if("nap").alias("naps"), F.countDistinct(F.when(F.col("nap"), monday(F.col("day")))).alias("nap_weeks"))
    share, naps, weeks = F.col("naps") / F.col("n"), F.col("naps"), F.col("nap_weeks")
    return g.select(*KEY, naps, share.alias("nap_share"), weeks, ((naps >= 3) & (share >= 0.1) & (weeks >= 2)).alias("nap_eligible"),
                    ((naps >= F.greatest(F.lit(3), F.ceil(F.col("n") * 0.2))) & (share >= 0.2) & (weeks >= 2)).alias("nap_defining"))


def features(windowed: DataFrame) -> DataFrame:
    """Valid days of each window with f0..f8: clock terms, nap, then clipped metric terms (0 without value or scale).

    All statistics are window aggregates over (person, window_end), so one shuffle serves them and what follows.
    """
    w = Window.partitionBy(*KEY)
    n = F.count("*").over(w)
    rows = windowed.where("valid")
    terms = []
    for i, (m, floor, weight) in enumerate(METRICS):
        q = F.percentile(m, F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8))).over(w)
        rows = rows.withColumns({f"q_{m}": q, f"n_{m}": F.count(m).over(w)})
        scale = F.greatest(F.lit(floor), (F.col(f"q_{m}")[2] - F.col(f"q_{m}")[0]) / 1.28)
        enough = F.col(f"n_{m}") >= F.greatest(F.lit(6), F.ceil(F.col("n") * 0.5))
        terms.append(F.when(enough & F.col(m).isNotNull(), clamp((F.col(m) - F.col(f"q_{m}")[1]) / scale, -2.5, 2.5) * weight).otherwise(0.0).alias(f"f{4 + i}"))
    rows = rows.withColumns({"n": n, "naps": F.count_if("nap").over(w), "nap_weeks": F.size(F.collect_set(F.when(F.col("nap"), monday(F.col("day")))).over(w))})
    eligible = (F.col("naps") >= 3) & (F.col("naps") / F.col("n") >= 0.1) & (F.col("nap_weeks") >= 2)
    clock = [((F.col(c) - m) / s).alias(f"f{i}") for i, (c, m, s) in enumerate(CLOCK)]
    return rows.select(*KEY, "day", "bed", "quality", *clock, F.when(F.col("nap") & eligible, 0.8).otherwise(0.0).alias("f3"), *terms)
