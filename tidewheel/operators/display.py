"""Series behind charts: depth at a clock hour, bands, densities, overlaps, coverage calendars, daily summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp, half_up, monday
from .windows import KEY

CLUSTER = [*KEY, "cluster"]
# Chart range in hours and its step; kernel widths; slack of a band.
FIRST, LAST, STEP = 18.0, 42.0, 0.125
PATTERN_WIDTH, LANDSCAPE_WIDTH, SLACK = 0.23, 0.24, 0.025


def depth_at(hour: Column, bed: Column, wake: Column, profile: Column) -> Column:
    """Depth of a night at an hour, linear between the points of its profile; 0 outside the night or without a profile."""
    x = clamp((hour - bed) / F.greatest(F.lit(0.01), wake - bed)) * (F.size(profile) - 1)
    lo = F.floor(x).cast("int")
    hi = F.least(F.size(profile) - 1, lo + 1)
    inside = (hour >= bed) & (hour <= wake) & (F.coalesce(F.size(profile), F.lit(0)) > 0)
    return F.when(inside, F.get(profile, lo) * (1 - (x - lo)) + F.get(profile, hi) * (x - lo)).otherwise(0.0)


def smoothed(value: Column, order: Window, radius: int) -> Column:
    """Gaussian mean of the rows up to radius away, with the weights of those that exist."""
    sigma = max(1.0, radius * 0.62)
    total, weights = F.lit(0.0), F.lit(0.0)
    for o in range(-radius, radius + 1):
        w = math.exp(-(o * o) / (2 * sigma * sigma))
        v = F.lead(value, o).over(order) if o >= 0 else F.lag(value, -o).over(order)
        total, weights = total + F.coalesce(v * w, F.lit(0.0)), weights + F.when(v.isNotNull(), w).otherwise(0.0)
    return total / F.greatest(F.lit(1e-6), weights)


def core_nights(members: DataFrame, days: DataFrame, ends: DataFrame) -> DataFrame:
    """(person, window_end, cluster, day, bed, wake, profile): core days of the patterns of the given windows."""
    core = members.where("membership = 'core'").select(*CLUSTER, "day").join(ends, KEY, "left_semi")
    return core.join(days.select("person", "day", "bed", "wake", "profile"), ["person", "day"])


def grid() -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(round((LAST - FIRST) / STEP))), lambda i: i * STEP + FIRST)


def sampled(core: DataFrame) -> DataFrame:
    """(pattern, hour, day, depth): each core night at each hour of its pattern's range, p3 of bed to p97 of wake, on the grid between."""
    ends = core.groupBy(*CLUSTER).agg(F.percentile("bed", 0.03).alias("lo"), F.percentile("wake", 0.97).alias("hi"))
    first, last = F.ceil(F.col("lo") / STEP), F.ceil(F.col("hi") / STEP) - 1
    steps = F.when(last >= first, F.transform(F.sequence(first, last), lambda i: i * STEP)).otherwise(F.array().cast("array<double>"))
    inner = F.filter(steps, lambda h: h > F.col("lo") + 1e-6)
    hours = ends.select(*CLUSTER, F.explode(F.concat(F.array("lo"), inner, F.array("hi"))).alias("hour"))
    depth = depth_at(F.col("hour"), F.col("bed"), F.col("wake"), F.col("profile"))
    return hours.join(core, CLUSTER).select(*CLUSTER, "hour", "day", depth.alias("depth"))


def stage_band(core: DataFrame) -> DataFrame:
    """(pattern, hour, low, high): p15 and p85 of depth, smoothed with radius 4, then 3."""
    order = Window.partitionBy(*CLUSTER).orderBy("hour")
    rows = sampled(core).groupBy(*CLUSTER, "hour").agg(F.percentile("depth", 0.15).alias("low"), F.percentile("depth", 0.85).alias("high"))
    for radius in (4, 3):
        rows = rows.withColumns({c: smoothed(F.col(c), order, radius) for c in ("low", "high")})
    return rows


def density(rows: DataFrame, keys: list[str], width: float, levels: int = 13) -> DataFrame:
    """(keys, level, density): mean of unscaled Gaussian kernels around depths, at levels from 0 to 3."""
    level = F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: i * 3.0 / (levels - 1))).alias("level")
    z = (F.col("level") - F.col("depth")) / width
    return rows.select(*keys, "depth", level).groupBy(*keys, "level").agg(F.avg(F.exp(-0.5 * z * z)).alias("density"))


def pattern_density(core: DataFrame) -> DataFrame:
    return density(sampled(core), [*CLUSTER, "hour"], PATTERN_WIDTH)


def _on_grid(rows: DataFrame) -> DataFrame:
    each = rows.withColumn("hour", F.explode(grid()))
    return each.withColumn("depth", depth_at(F.col("hour"), F.col("bed"), F.col("wake"), F.col("profile")))


def landscape_density(core: DataFrame) -> DataFrame:
    return density(_on_grid(core), [*CLUSTER, "hour"], LANDSCAPE_WIDTH)


def landscape_series(nights: DataFrame, core: DataFrame) -> DataFrame:
    """(person, day, cluster, hour, actual, low, high, bed, wake): a night on the grid against the band of a pattern.

    nights: (person, day, window_end, cluster, bed, wake, profile), a night and the pattern that it is held against.
    The night is smoothed with radius 3, then 2; the band, p15 to p85 of the core nights, with 3.
    """
    by_night = Window.partitionBy("person", "day", "cluster").orderBy("hour")
    own = _on_grid(nights).select(*CLUSTER, "day", "bed", "wake", "hour", F.col("depth").alias("actual"))
    for radius in (3, 2):
        own = own.withColumn("actual", smoothed(F.col("actual"), by_night, radius))
    band = _on_grid(core).groupBy(*CLUSTER, "hour").agg(F.percentile("depth", 0.15).alias("low"), F.percentile("depth", 0.85).alias("high"))
    order = Window.partitionBy(*CLUSTER).orderBy("hour")
    band = band.withColumns({c: smoothed(F.col(c), order, 3) for c in ("low", "high")})
    return own.join(band, [*CLUSTER, "hour"]).select("person", "day", "cluster", "hour", "actual", "low", "high", "bed", "wake")


def overlaps(series: DataFrame) -> DataFrame:
    """(person, day, cluster, start, end, points): runs of two or more points, within the night, inside the band and its slack."""
    night = Window.partitionBy("person", "day", "cluster").orderBy("hour")
    inside = (F.col("actual") >= F.col("low") - SLACK) & (F.col("actual") <= F.col("high") + SLACK)
    rows = series.where("hour BETWEEN bed AND wake").withColumn("inside", inside)
    rows = rows.withColumn("island", F.count_if(~F.col("inside")).over(night)).where("inside")
    runs = rows.groupBy("person", "day", "cluster", "island").agg(F.min("hour").alias("start"), F.max("hour").alias("end"), F.count("*").alias("points"))
    return runs.where("points > 1").drop("island")


def coverage_calendar(patterns: DataFrame, members: DataFrame, days: DataFrame, counts: DataFrame) -> DataFrame:
    """(pattern, week, weekday, date, state, nap): whole weeks around each pattern's window, Monday first.

    state: outside the window, missing (no valid day), core, boundary or rest. patterns: (person, window_end, cluster).
    """
    span = counts.select(*KEY, "window_start").withColumn("monday", monday(F.col("window_start")))
    weeks = F.ceil((F.datediff("window_end", "monday") + 1) / 7).cast("int")
    cells = patterns.select(*CLUSTER).join(span, KEY).withColumn("i", F.explode(F.sequence(F.lit(0), weeks * 7 - 1)))
    cells = cells.withColumn("date", F.expr("date_add(monday, i)"))
    own = members.where("membership <> 'unassigned'").select(*CLUSTER, F.col("day").alias("date"), "membership")
    valid = days.where("valid").select("person", F.col("day").alias("date"), "nap", F.lit(True).alias("there"))
    rows = cells.join(valid, ["person", "date"], "left").join(own, [*CLUSTER, "date"], "left")
    outside = (F.col("date") < F.col("window_start")) | (F.col("date") > F.col("window_end"))
    state = F.when(outside, "outside").when(F.col("there").isNull(), "missing").otherwise(F.coalesce("membership", F.lit("rest")))
    nap = (state == "core") & F.coalesce("nap", F.lit(False))
    return rows.select(*CLUSTER, F.floor(F.col("i") / 7).alias("week"), (F.col("i") % 7).cast("long").alias("weekday"), "date", state.alias("state"), nap.alias("nap"))


def overview(counts: DataFrame, members: DataFrame, patterns: DataFrame, days: DataFrame, least: int = 4) -> DataFrame:
    """A row for each window: overview state, shown and hidden patterns, boundary and unassigned days, weeks observed.

    ineligible: a person with fewer than four valid days at all; visible: some pattern is shown; else learning.
    """
    valid = days.groupBy("person").agg(F.count_if("valid").alias("ever"))
    kind = lambda k: F.count_if(F.col("membership") == k).alias(k)
    by_day = members.groupBy(*KEY).agg(kind("boundary"), kind("unassigned"))
    by_pattern = patterns.groupBy(*KEY).agg(F.count("*").alias("candidates"), F.count_if("shown").alias("visible"))
    rows = counts.join(valid, "person").join(by_day, KEY, "left").join(by_pattern, KEY, "left").na.fill(0, ["boundary", "unassigned", "candidates", "visible"])
    state = F.when(F.col("ever") < least, "ineligible").when(F.col("visible") > 0, "visible").otherwise("learning")
    weeks = F.least(F.lit(6), F.ceil(F.col("available") / 7)).cast("long")
    return rows.select(*KEY, state.alias("state"), "visible", (F.col("candidates") - F.col("visible")).alias("hidden"), "boundary", "unassigned", (F.col("boundary") + F.col("unassigned")).alias("variation"), weeks.alias("weeks"), (F.col("available") == 42).alias("full"))


def stage_hours(share: Column, in_bed: Column, duration: Column) -> Column:
    """Hours of a stage: of the time in bed, or of the sleep where that is null or 0."""
    return F.greatest(F.lit(0.0), F.coalesce(F.nullif(in_bed, F.lit(0.0)), duration, F.lit(0.0)) * F.coalesce(share, F.lit(0.0)))


def daily(days: DataFrame) -> DataFrame:
    """Valid days with totals, efficiency, stage hours, context figures and one context tag.

    days: (person, day, bed, wake, duration, in_bed, nap_hours, nap, deep, light, rem, exercise_known, minutes, meals, fluid,
    alcohol, stress, evening_exercise). The tag is later exercise before alcohol before nap.
    """
    asleep, in_bed = F.col("duration") + F.coalesce("nap_hours", F.lit(0.0)), F.col("in_bed") + F.coalesce("nap_hours", F.lit(0.0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    tag = F.when(yes("evening_exercise"), "exercise").when(yes("alcohol"), "alcohol").when(yes("nap"), "nap")
    return days.where("valid").select(
        "person", "day", asleep.alias("asleep"), in_bed.alias("in_bed"), half_up(asleep / F.greatest(F.lit(0.01), in_bed) * 100).alias("efficiency"),
        *(stage_hours(F.col(s), F.col("in_bed"), F.col("duration")).alias(f"{s}_hours") for s in ("deep", "light", "rem")),
        F.when(yes("exercise_known"), half_up(F.coalesce("minutes", F.lit(0.0)))).alias("exercise_minutes"),
        "meals", "fluid", "stress", tag.alias("tag"), ((F.col("bed") - FIRST) / 24 * 100).alias("left"), ((F.col("wake") - F.col("bed")) / 24 * 100).alias("width"),
    )
