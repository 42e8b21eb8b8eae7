"""Night metrics from heart-rate samples, and exercise around a night."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp


def owned(nights: DataFrame) -> DataFrame:
    """nights with own_from: of nights of a person that overlap, an instant belongs to the one that began first; each owns what follows the ends of all before it.

    Nights that own nothing go. (person, start_ts, night) orders a person's nights.
    """
    before = Window.partitionBy("person").orderBy("start_ts", "night").rowsBetween(Window.unboundedPreceding, -1)
    return nights.withColumn("own_from", F.greatest("start_ts", F.max("end_ts").over(before))).where("own_from < end_ts")


def samples_in_nights(samples: DataFrame, nights: DataFrame) -> DataFrame:
    """Interval join: each usable sample to the open night, start <= ts < end, that began first.

    Nights are made disjoint, spread over the hours that they touch and meet samples by an equality of (person, hour), so a sample meets one night and is not
    compared with others.
    """
    usable = samples.where("bpm BETWEEN 30 AND 220 AND confidence >= 1").withColumn("hour", F.date_trunc("hour", "ts"))
    spread = owned(nights).withColumn("hour", F.explode(F.sequence(F.date_trunc("hour", "own_from"), F.date_trunc("hour", "end_ts"), F.expr("interval 1 hour"))))
    return usable.join(spread, ["person", "hour"]).where("ts >= own_from AND ts < end_ts").drop("hour", "own_from")


def once(joined: DataFrame) -> DataFrame:
    """One row a person and event_id, the one of the night that began first, where samples may repeat ids."""
    first = F.row_number().over(Window.partitionBy("person", "event_id").orderBy("start_ts", "night"))
    return joined.withColumn("r", first).where("r = 1").drop("r")


def heart_metrics(joined: DataFrame, min_samples: int = 120, min_coverage: float = 0.5) -> DataFrame:
    """Per night: samples, minute coverage, share of confident samples, and median and low bpm (the first that half, and a tenth, do not exceed) where there are enough.

    Samples are counted by bpm and by minute where they lie; these counts, not samples, are shuffled.
    """
    minutes = (F.unix_timestamp(F.col("end_ts").cast("timestamp")) - F.unix_timestamp(F.col("start_ts").cast("timestamp"))) / 60
    rows = joined.select("person", "night", "bpm", F.date_trunc("minute", "ts").alias("minute"), minutes.alias("minutes"), (F.col("confidence") >= 2).cast("long").alias("sure"))
    counts = rows.groupingSets([["person", "night", "bpm"], ["person", "night", "minute"]], "person", "night", "bpm", "minute").agg(F.count("*").alias("n"), F.sum("sure").alias("sure"), F.max("minutes").alias("minutes"), F.grouping("bpm").alias("by_minute"))
    by_bpm = F.col("by_minute") == 0
    below = F.sum("n").over(Window.partitionBy("person", "night", "by_minute").orderBy("bpm", "minute"))  # a row a bpm or a minute, at most a night's
    g = counts.withColumn("below", below).withColumn("all", F.sum(F.when(by_bpm, F.col("n"))).over(Window.partitionBy("person", "night"))).groupBy("person", "night").agg(
        F.first("all").alias("n"), F.count_if(~by_bpm).alias("seen"), F.max("minutes").alias("minutes"), F.sum(F.when(by_bpm, F.col("sure"))).alias("sure"),
        *(F.min(F.when(by_bpm & (F.col("below") * 100 >= F.col("all") * p), F.col("bpm"))).alias(f"p{p}") for p in (50, 10)),
    )
    coverage = clamp(F.col("seen") / F.greatest(F.lit(1), "minutes"))
    enough = (F.col("n") >= min_samples) & (coverage >= min_coverage)
    return g.select("person", "night", "n", coverage.alias("coverage"), (F.col("sure") / F.col("n")).alias("confident"), F.when(enough, F.col("p50")).alias("median_bpm"), F.when(enough, F.col("p10")).alias("low_bpm"))


def settling(joined: DataFrame, horizon: int = 90, frame: int = 20) -> DataFrame:
    """Minute medians of each night; the first minute from which a frame of 20 holds 12 or more, 80 % of them within 3 of the night's lower quartile."""
    minute = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("start_ts").cast("timestamp"))) / 60)
    by = joined.groupBy("person", "night", minute.alias("minute")).agg(F.percentile("bpm", 0.5).alias("bpm"))
    base = by.groupBy("person", "night").agg(F.percentile("bpm", 0.25).alias("baseline"), F.count_if(F.col("minute") < horizon).alias("observed"))
    spine = base.withColumn("minute", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(horizon - 1).cast("long"))))
    rows = spine.join(by, ["person", "night", "minute"], "left")
    w = Window.partitionBy("person", "night").orderBy("minute").rowsBetween(0, frame - 1)
    calm = F.count_if(F.col("bpm") <= F.col("baseline") + 3).over(w)
    seen = F.count("bpm").over(w)
    marked = rows.withColumns({"calm": calm, "seen": seen})
    ok = (F.col("minute") <= horizon - frame) & (F.col("seen") >= 12) & (F.col("calm") >= 0.8 * F.col("seen"))
    opening = F.percentile(F.when(F.col("minute") < 15, F.col("bpm")), 0.5)
    g = marked.groupBy("person", "night").agg(F.first("baseline").alias("baseline"), F.first("observed").alias("observed"), F.coalesce(F.min(F.when(ok, F.col("minute"))), F.lit(horizon)).alias("m"), opening.alias("opening"), F.avg(F.when(F.col("bpm").isNotNull(), (F.col("bpm") > F.col("baseline") + 3).cast("double"))).alias("high"))
    enough = F.col("observed") / horizon >= 0.6
    return g.select("person", "night", (F.col("observed") / horizon).alias("first_coverage"), F.when(enough, F.col("m")).alias("settling_minutes"), F.when(enough, F.col("m") < horizon).alias("settled"),
                    F.when(enough, F.greatest(F.lit(0.0), F.coalesce(F.col("opening") - F.col("baseline"), F.lit(0.0)))).alias("opening_delta"), F.when(enough, F.col("high")).alias("high_share"))


def exercise_before(nights: DataFrame, exercise: DataFrame, hours: int = 18, recent_hours: int = 6) -> DataFrame:
    """Range join: exercise that starts within so many hours before a night, by day bucket; sums, flags, hours from the last end, kinds.

    exercise: (person, start_ts, minutes, kind), with end_ts and intensity_minutes where they are known.
    """
    back = -(-hours // 24)
    spread = nights.withColumn("d", F.explode(F.sequence(F.date_sub(F.to_date("start_ts"), back), F.to_date("start_ts"))))
    end = F.col("end_ts") if "end_ts" in exercise.columns else F.expr("start_ts + make_dt_interval(0, 0, 0, floor(minutes * 60))")
    intense = F.col("intensity_minutes") if "intensity_minutes" in exercise.columns else F.lit(0.0)
    own = exercise.select("person", F.col("start_ts").alias("x_start"), end.alias("x_end"), intense.alias("intense"), "minutes", "kind", F.to_date("start_ts").alias("d"))
    inside = (F.col("x_start") < F.col("start_ts")) & (F.col("x_start") >= F.expr(f"start_ts - interval {hours} hours"))
    met = spread.join(own, ["person", "d"]).where(inside)
    recent = F.col("x_end") >= F.expr(f"start_ts - interval {recent_hours} hours")
    g = met.groupBy("person", "night").agg(
        F.count("*").alias("exercises"), F.sum("minutes").alias("minutes"), F.sum(F.when(recent, F.col("minutes")).otherwise(0.0)).alias("recent_minutes"), F.sum("intense").alias("intensity_minutes"),
        F.round(F.timestamp_diff("MICROSECOND", F.max("x_end"), F.first("start_ts")) / 3.6e9, 2).alias("last_end_hours"), F.concat_ws(",", F.sort_array(F.collect_set("kind"))).alias("kinds"),
    )
    return g.withColumns({"evening": F.col("recent_minutes") >= 15, "high_load": F.col("minutes") >= 60})
