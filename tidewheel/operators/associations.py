"""What surrounds a pattern: exposures of its core days against all other valid days of the window, by strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp, is_rest_day
from .windows import KEY

PATTERN = [*KEY, "cluster"]


def exposures() -> list[tuple[str, str, Column, Column]]:
    """(id, source, observed, exposed) of each definition; the list may be extended by callers."""
    t = F.lit(True)
    food = F.coalesce("food_reported", F.lit(False))
    return [
        ("inferred_rest_day", "calendar", t, is_rest_day(F.col("day"))),
        ("evening_exercise", "exercise", F.col("exercise_known"), F.col("evening_exercise")),
        ("high_exercise_load", "exercise", F.col("exercise_known"), F.col("high_load")),
        ("late_dinner", "food", food, F.col("dinner")),
        ("alcohol", "food", food, F.col("alcohol")),
        ("low_hydration", "food", food & F.col("fluid").isNotNull(), F.col("fluid") < 5),
        ("high_stress", "wellness", F.coalesce("wellness_reported", F.lit(False)) & F.col("stress").isNotNull(), F.col("stress") >= 4),
    ]


def associations(windowed: DataFrame, members: DataFrame, definitions: list | None = None) -> DataFrame:
    """One row per pattern and definition: counts, log odds, strength, coverage, confidence, shown.

    windowed: days of windows with context; members: (person, window_end, day, cluster, membership).
    Calendar counts are raw; others keep strata (rest day or not) in which both sides are observed.
    """
    definitions = definitions or exposures()
    days = windowed.where("valid").select(*KEY, "day", is_rest_day(F.col("day")).alias("rest"), F.explode(F.array(*(
        F.struct(F.lit(i).alias("definition"), F.lit(s).alias("source"), F.coalesce(o, F.lit(False)).alias("observed"), F.coalesce(e, F.lit(False)).alias("exposed")) for i, s, o, e in definitions
    ))).alias("x")).select(*KEY, "day", "rest", "x.*")
    core = members.where("membership = 'core'").select(*PATTERN, "day")
    patterns = core.groupBy(*PATTERN).agg(F.count("*").alias("core_days"))
    sides = days.join(patterns, KEY).join(core.withColumn("own", F.lit(True)), [*PATTERN, "day"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    stratum = F.when(F.col("source") == "calendar", F.lit(None)).otherwise(F.col("rest"))
    count = lambda own, hit: F.count_if((F.col("own") == own) & (F.col("exposed") == hit))
    by = sides.where("observed").groupBy(*PATTERN, "core_days", "definition", "source", stratum.alias("stratum")).agg(count(True, True).alias("a"), count(True, False).alias("b"), count(False, True).alias("c"), count(False, False).alias("d"))
    a, b, c, d = (F.col(x) for x in "abcd")
    both = ((a + b) > 0) & ((c + d) > 0)
    t = a + b + c + d + 2
    w = Window.partitionBy(*PATTERN, "definition")
    kept = by.withColumns({"ok": both, "any": F.max(both).over(w)}).where("ok OR NOT any OR source = 'calendar'")
    g = kept.groupBy(*PATTERN, "core_days", "definition", "source").agg(
        *(F.sum(x).alias(x) for x in "abcd"), F.sum((a + 0.5) * (d + 0.5) / t).alias("up"), F.sum((b + 0.5) * (c + 0.5) / t).alias("down"), F.max("any").alias("any")
    )
    raw = F.log((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)))
    lo = F.when((F.col("source") == "calendar") | ~F.col("any"), raw).otherwise(F.log(F.col("up") / F.greatest(F.lit(1e-6), F.col("down"))))
    g = g.withColumn("log_odds", lo).withColumn("turned", (F.col("source") == "calendar") & (F.col("log_odds") < 0))
    turn = lambda x, y: F.when(F.col("turned"), F.col(y)).otherwise(F.col(x))
    g = g.select(*PATTERN, "core_days", F.when(F.col("turned"), "before_inferred_work_day").otherwise(F.col("definition")).alias("definition"), "source",
                 turn("a", "b").alias("a"), turn("b", "a").alias("b"), turn("c", "d").alias("c"), turn("d", "c").alias("d"), F.abs("log_odds").alias("x"), "turned", "log_odds").withColumn("log_odds", F.when(F.col("turned"), F.col("x")).otherwise(F.col("log_odds"))).drop("x", "turned")
    strength = F.tanh(F.abs("log_odds") / 2)
    coverage = (F.col("a") + F.col("b")) / F.col("core_days")
    support = F.when(F.col("log_odds") >= 0, F.col("a")).otherwise(F.col("b"))
    comparison = F.col("c") + F.col("d")
    evidence = (1 - F.exp(-support / 4)) * (1 - F.exp(-comparison / 6))
    out = g.withColumns({"strength": strength, "coverage": coverage, "support": support, "comparison": comparison}).withColumn("confidence", clamp(F.col("coverage") * evidence * (0.45 + 0.55 * F.col("strength"))))
    return out.withColumn("shown", (F.col("support") >= 2) & (F.col("comparison") >= 3) & (F.col("log_odds") > 0) & (F.col("strength") >= 0.15) & (F.col("confidence") >= 0.25))
