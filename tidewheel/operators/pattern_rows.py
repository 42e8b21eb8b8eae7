"""What a pattern is called and shows: identity, ranges, metric summaries, extra sleep, stage shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clock_label, duration_label, half_up, monday
from .windows import KEY

CLUSTER = [*KEY, "cluster"]
METRICS = ("median_bpm", "low_bpm", "settling", "resting_bpm", "disruption")
STAGES = ("deep", "light", "rem")
# Bed time that parts earlier from later where there is one pattern; difference of durations that counts.
EARLIER, LENGTH = 24.35, 0.18


def _span(x: Column, label, pad: float) -> Column:
    return F.concat(label(x[0] - pad), F.lit("–"), label(x[2] + pad))


def _tenth(x: Column) -> Column:
    """One digit, halves up; what differs only behind six more digits is equal."""
    return half_up(F.round(x * 10, 6)) / 10


def identity(rank: Column, patterns: Column, usual_bed: Column) -> tuple[Column, Column]:
    """(timing, pattern_id) of the pattern of a rank among those of its window."""
    timing = F.when(patterns == 1, F.when(usual_bed < EARLIER, "earlier").otherwise("later")).when(rank == 1, "earlier").when(rank == patterns, "later").otherwise("middle")
    return timing, F.when(timing == "earlier", "earlier-sleep").when(timing == "later", "later-longer-sleep").otherwise(F.concat(F.lit("middle-sleep-"), (rank - 1).cast("string")))


def names(published: DataFrame) -> DataFrame:
    """(person, window_end, cluster, pattern_id) of published patterns, without the days that make them."""
    every = published.select(*CLUSTER, "rank", "median_bed", F.count("*").over(Window.partitionBy(*KEY)).alias("patterns"))
    return every.select(*CLUSTER, identity(F.col("rank"), F.col("patterns"), F.col("median_bed"))[1].alias("pattern_id"))


def rows(members: DataFrame, days: DataFrame, published: DataFrame) -> DataFrame:
    """A row for each pattern: id, timing, length, place by emergence, ranges of the days that make its shape, summaries.

    members: rows of membership(); the shape is made by the core days, or by all days with weight where there are
    fewer than two. One pattern of a window is earlier or later; of several, the first is earlier, the last is
    later, others are between. place is by emergence, then by bed time.
    """
    w, c = Window.partitionBy(*KEY), Window.partitionBy(*CLUSTER)
    own = members.where("membership <> 'unassigned'").select(*CLUSTER, "day", "membership").join(days, ["person", "day"])
    own = own.withColumns({"cores": F.count_if(F.col("membership") == "core").over(c), "usual": F.percentile("duration", 0.5).over(w)})
    shape = (F.col("cores") < 2) | (F.col("membership") == "core")
    only = lambda x: F.when(shape, x)
    three = lambda m, lo, hi: F.percentile(only(F.col(m)), F.array(F.lit(lo), F.lit(0.5), F.lit(hi)))
    nap = shape & F.coalesce("nap", F.lit(False))
    g = own.groupBy(*CLUSTER).agg(
        F.percentile("bed", 0.5).alias("usual_bed"), F.percentile("duration", 0.5).alias("own_duration"), F.first("usual").alias("usual"), F.count_if(shape).alias("n"),
        *(three(m, 0.2, 0.8).alias(f"q_{m}") for m in ("bed", "wake", "duration", *METRICS)), *(F.count(only(F.col(m))).alias(f"{m}_count") for m in METRICS),
        *(three(s, 0.15, 0.85).alias(f"q_{s}") for s in STAGES),
        F.count_if(nap).alias("naps"), F.countDistinct(F.when(nap, monday(F.col("day")))).alias("nap_weeks"),
    )
    g = g.join(published.select(*CLUSTER, "rank", "emergence", "confidence", "status", "shown", "core_days"), CLUSTER)
    count, rank = F.count("*").over(w), F.col("rank")
    g = g.withColumns({"patterns": count, "place": F.row_number().over(w.orderBy(F.desc("emergence"), "rank")).cast("long")})
    gap = F.col("own_duration") - F.col("usual")
    length = F.when(gap >= LENGTH, "longer").when(gap <= -LENGTH, "shorter").otherwise("steady")
    timing, name = identity(rank, F.col("patterns"), F.col("usual_bed"))
    g = g.withColumns({"timing": timing, "length": length})
    share = F.col("naps") / F.col("n")
    defining = (F.col("naps") >= F.greatest(F.lit(3), F.ceil(F.col("n") * 0.2))) & (share >= 0.2) & (F.col("nap_weeks") >= 2)
    q = lambda m: F.col(f"q_{m}")
    return g.select(
        *CLUSTER, name.alias("pattern_id"), "timing", "length", "rank", "place", "emergence", "confidence", "status", "shown", "core_days",
        _span(q("bed"), clock_label, 0.03).alias("start_range"), _span(q("wake"), clock_label, 0.03).alias("wake_range"), _span(q("duration"), duration_label, 0.0).alias("duration_range"),
        *(q(m)[i].alias(f"{x}_{end}") for m, x in (("bed", "start"), ("wake", "wake"), ("duration", "duration")) for i, end in ((0, "low"), (2, "high"))),
        *(x for m in METRICS for x in (F.col(f"{m}_count"), *(_tenth(q(m)[i]).alias(f"{m}_{e}") for i, e in enumerate(("low", "typical", "high"))))),
        *(q(s)[i].alias(f"{s}_{e}") for s in STAGES for i, e in enumerate(("p15", "p50", "p85"))),
        F.greatest(*(F.col(f"{m}_count") for m in METRICS[:4])).alias("physiology_nights"),
        "naps", share.alias("nap_share"), "nap_weeks", defining.alias("nap_defining"),
        ((q("bed")[0] - 18) / 24 * 100).alias("band_left"), ((q("wake")[2] - q("bed")[0]) / 24 * 100).alias("band_width"),
    )


def evidence(members: DataFrame) -> DataFrame:
    """(person, window_end, cluster, core, boundary, every): each pattern's days, newest first. A window has 42 days at most."""
    day = lambda kind: F.sort_array(F.collect_list(F.when(kind, F.col("day"))), asc=False)
    m = F.col("membership")
    return members.where("membership <> 'unassigned'").groupBy(*CLUSTER).agg(day(m == "core").alias("core"), day(m == "boundary").alias("boundary"), day(F.lit(True)).alias("every"))


def variation(members: DataFrame) -> DataFrame:
    """Boundary and unassigned days of each window, newest first by place."""
    kinds = [members.where(F.col("membership") == k).select(*KEY, "day", F.lit(k).alias("membership")) for k in ("boundary", "unassigned")]
    return kinds[0].unionByName(kinds[1]).withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("day"))).cast("long"))
