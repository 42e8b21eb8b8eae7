"""How well a night fits patterns that only earlier days made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linear import let
from ..functions.scalar import clamp, half_up
from .windows import KEY

# Weights of the dimensions; least spreads of the measures.
WEIGHTS = {"timing": 0.28, "duration_fit": 0.12, "landscape": 0.25, "composition": 0.12, "physiology": 0.16, "early_night": 0.07}
SPREADS = {"bed": 0.55, "wake": 0.65, "duration": 0.7, "disruption": 4.0, "median_bpm": 5.0, "low_bpm": 5.0, "resting_bpm": 5.0, "settling": 18.0}
STAGES = ("deep", "light", "rem")


def references(days: DataFrame, members: DataFrame) -> DataFrame:
    """p15, median and p85 of each measure over the core days of each pattern. days: one row a person and day."""
    core = members.where("membership = 'core'").select(*KEY, "day", "cluster")
    q = [F.percentile(m, F.array(F.lit(0.15), F.lit(0.5), F.lit(0.85))).alias(f"q_{m}") for m in SPREADS]
    stages = [F.percentile(s, 0.5).alias(f"s_{s}") for s in STAGES]
    return core.join(days, ["person", "day"]).groupBy(*KEY, "cluster").agg(F.count("*").alias("cores"), *q, *stages)


def _close(m: str) -> Column:
    q = F.col(f"q_{m}")
    z = F.abs(F.col(m) - q[1]) / F.greatest(F.lit(SPREADS[m]), (q[2] - q[0]) / 2)
    return F.exp(-0.5 * z * z)


def _mean(*xs: Column) -> Column:
    """Of those that are there; null if none is."""
    n = sum((x.isNotNull().cast("int") for x in xs), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0)) / n)


def resample(profile: Column, points: int = 36) -> Column:
    """A profile array at evenly spaced points, linearly."""
    last = F.size(profile) - 1

    def at(i: Column) -> Column:
        x = i * last / (points - 1)
        lo = F.floor(x).cast("int")
        return F.get(profile, lo) + (F.get(profile, F.least(lo + 1, last)) - F.get(profile, lo)) * (x - lo)

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)


#: Points at which profiles are compared.
POINTS = 36


def shapes(profiles: DataFrame, members: DataFrame) -> DataFrame:
    """(person, window_end, cluster, middle): medians of the profiles, resampled to POINTS, of each pattern's core days."""
    core = members.where("membership = 'core'").select(*KEY, "day", "cluster")
    middle = F.array(*(F.percentile(F.get("own", F.lit(i)), 0.5) for i in range(POINTS))).alias("middle")
    return core.join(outlines(profiles), ["person", "day"]).groupBy(*KEY, "cluster").agg(middle)


def outlines(profiles: DataFrame) -> DataFrame:
    """(person, day, own): profiles resampled to POINTS; nights without one have no row."""
    return profiles.where(F.size("profile") > 0).select("person", "day", resample(F.col("profile"), POINTS).alias("own"))


def resemblance(own: Column, middle: Column) -> Column:
    """How alike two resampled profiles of depths from 0 to 3 are: levels weigh 0.78, changes 0.22. Null if one is."""
    mean = lambda xs, n: F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.abs(x) / 3) / n
    changes = lambda gaps: F.transform(F.sequence(F.lit(1), F.lit(POINTS - 1)), lambda i: F.get(gaps, i) - F.get(gaps, i - 1))
    alike = let(F.zip_with(own, middle, lambda x, y: x - y), lambda gaps: clamp(1 - (mean(gaps, POINTS) * 0.78 + mean(changes(gaps), POINTS - 1) * 0.22)))
    return F.when(own.isNotNull() & middle.isNotNull(), alike)


def landscape(profiles: DataFrame, members: DataFrame) -> DataFrame:
    """(person, window_end, day, cluster, landscape): each night's profile against the medians of the core days of the patterns of the day before.

    profiles: (person, day, profile). Nights without a profile, and patterns without one, have no row.
    """
    rows = outlines(profiles).withColumn("window_end", F.date_sub("day", 1)).join(shapes(profiles, members), KEY)
    return rows.select(*KEY, "day", "cluster", resemblance(F.col("own"), F.col("middle")).alias("landscape"))


def fits(days: DataFrame, patterns: DataFrame, refs: DataFrame, landscape: DataFrame) -> DataFrame:
    """Each valid night against each shown pattern of the window that ended the day before: breakdown, raw and shrunk score.

    patterns: (person, window_end, cluster, confidence, emergence, rank, shown); landscape: rows of landscape().
    """
    prior = patterns.where("shown").select(*KEY, "cluster", "confidence", "emergence", "rank").join(refs, [*KEY, "cluster"])
    rows = days.where("valid").withColumn("window_end", F.date_sub("day", 1)).join(prior, KEY)
    return scored(rows.join(landscape, [*KEY, "day", "cluster"], "left"))


def scored(rows: DataFrame) -> DataFrame:
    """rows, each a night beside a pattern's references and with landscape, with the other dimensions and the score. Dimensions without data carry no weight."""
    rows = rows.withColumns({
        "timing": _mean(_close("bed"), _close("wake")), "duration_fit": _close("duration"),
        "composition": _mean(*(clamp(1 - F.abs(F.col(s) - F.col(f"s_{s}")) / 0.18) for s in STAGES)),
        "physiology": _mean(*(_close(m) for m in ("median_bpm", "low_bpm", "resting_bpm", "settling"))), "early_night": _close("disruption"),
    })
    used = sum((F.when(F.col(d).isNotNull(), w).otherwise(0.0) for d, w in WEIGHTS.items()), F.lit(0.0))
    got = sum((F.coalesce(F.col(d) * w, F.lit(0.0)) for d, w in WEIGHTS.items()), F.lit(0.0))
    raw = F.when(used > 0, got / used * 100).otherwise(0.0)
    trust = 0.45 * used + 0.55 * (0.65 * clamp(F.col("confidence") / 100) + 0.35 * clamp(F.col("cores") / 12))
    score = half_up(clamp(50 + (raw - 50) * (0.78 + 0.22 * trust), 0.0, 100.0))
    own = [*KEY, "day", "quality", "cluster", "confidence", "emergence", "rank", "cores", *WEIGHTS]
    return rows.select(*own, used.alias("coverage"), raw.alias("raw"), trust.alias("reliability"), score.alias("score"))


def ranked(fitted: DataFrame) -> DataFrame:
    """fitted with place: by score, then emergence, then bed time."""
    w = Window.partitionBy("person", "day").orderBy(F.desc("score"), F.desc("emergence"), "rank")
    return fitted.withColumns({"place": F.row_number().over(w).cast("long"), "second": F.lead("score").over(w), "second_cluster": F.lead("cluster").over(w)})


def best(fitted: DataFrame) -> DataFrame:
    """The best pattern of each night, its margin over the second, the state (matched, mixed or different) and the reason."""
    top = ranked(fitted).where("place = 1")
    margin = F.when(F.col("second").isNull(), 100).otherwise(F.col("score") - F.col("second"))
    s = F.col("score")
    mixed = (s >= 58) & (F.coalesce("second", F.lit(0)) >= 58) & (margin < 6)
    state = F.when(s < 58, "different").when(mixed, "mixed").otherwise("matched")
    label = F.when(s >= 82, "strong").when(s >= 70, "clear").when(s >= 58, "partial").otherwise("weak")
    sure = half_up(0.6 * F.col("confidence") + 0.25 * half_up(100 * F.col("reliability")) + 15 * clamp(F.coalesce("quality", F.lit(0.8))))
    top = top.withColumns({"state": state, "margin": margin, "label": F.when(mixed, "between").otherwise(label), "sure": sure})
    second = F.when(F.col("state") == "mixed", F.col("second_cluster")).alias("second_cluster")
    return top.select("person", "day", "window_end", "cluster", second, "score", "margin", "state", "label", "sure", reason().alias("reason"), F.col("cores").alias("evidence"), half_up(100 * F.col("coverage")).alias("signal_coverage"))


def reason() -> Column:
    """Why the best pattern came out best: the strongest dimension of a night that differs, else which levels stayed close.

    Of equal dimensions the first of WEIGHTS counts.
    """
    timing, land, body = (F.coalesce(x, F.lit(0.0)) for x in ("timing", "landscape", "physiology"))
    each = F.array(*(F.when(F.col(d).isNotNull(), F.struct(F.col(d).alias("v"), F.lit(-i).alias("i"), F.lit(d).alias("d"))) for i, d in enumerate(WEIGHTS)))
    strongest = F.coalesce(F.array_max(each)["d"], F.lit("few"))
    familiar = F.when((timing >= 0.78) & (land >= 0.72), "timing_and_landscape").when((body >= 0.74) & (land < 0.68), "physiology").when(timing >= land, "timing").otherwise("landscape")
    return F.when(F.col("state") == "different", F.concat(F.lit("closest_"), strongest)).when(F.col("state") == "mixed", "between").otherwise(familiar)


def past_nights() -> Column:
    """How many valid days of the person came before a day."""
    return F.coalesce(F.count_if("valid").over(Window.partitionBy("person").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def resonance(days: DataFrame, patterns: DataFrame, refs: DataFrame, landscape: DataFrame) -> DataFrame:
    """A row for each day: unavailable (not valid, or no profile), learning (nothing to compare with) or the state of best().

    days holds profile. past_nights counts the valid days before.
    """
    found = best(fits(days, patterns, refs, landscape))
    past = past_nights()
    rows = days.select("person", "day", (F.col("valid") & (F.coalesce(F.size("profile"), F.lit(0)) > 0)).alias("available"), past.alias("past_nights"))
    rows = rows.join(found, ["person", "day"], "left")
    has = F.col("available")
    state = F.when(~has, "unavailable").when(F.col("state").isNull(), "learning").otherwise(F.col("state"))
    rest = [F.when(has, F.col(c)).alias(c) for c in found.columns if c not in ("person", "day", "state", "window_end")]
    return rows.select("person", "day", state.alias("state"), "past_nights", *rest)
