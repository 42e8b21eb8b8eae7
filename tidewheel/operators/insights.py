"""Two signals of a pattern that rise together: late settling and early disruption, against the window's other nights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp, half_up, is_rest_day
from .associations import PATTERN
from .windows import KEY

#: Nights of a window with both signals, at least.
LEAST_SEEN = 10
#: Least share of a pattern's nights by scope; work nights come first.
LEAST_SHARE = {"work": 0.5, "sleep_day": 0.45}


def clause(own: Column, selected: Column, known: Column, bar: Column) -> Column:
    """Whether selected rows of a group stand high in a further measure: an aggregate over the group.

    own: the measure of selected rows, else null; selected: which rows those are; known and bar: how many nights of the window have the measure, and its
    60th percentile among them. It takes 8 such nights, values on max(3, 60 %) of the selected rows, and their median at the bar or above.
    """
    enough = (F.max(known) >= 8) & (F.count(own) >= F.greatest(F.lit(3), F.ceil(F.count_if(selected) * 0.6)))
    return F.coalesce(enough & (F.percentile(own, 0.5) >= F.max(bar)), F.lit(False))


def signals(windowed: DataFrame, members: DataFrame, measures: tuple[str, ...] = ()) -> DataFrame:
    """A row for each pattern and scope (work nights, all nights) with joint counts, contrast, confidence, shown and chosen.

    measures: further columns of windowed, as of movement or noise, each of which adds a column high_<measure>: whether the nights with both signals stand high in
    it against all nights of the window. late: whether the pattern's settling reaches its end, so that the difference is a lower bound. limited: whether
    a measure gives no support, or there is none.

    Medians of both sides are window aggregates over (pattern, scope), which the counts then group by: one shuffle.
    A pattern has one chosen row at most.
    """
    seen = windowed.where("valid AND settling IS NOT NULL AND disruption IS NOT NULL").withColumn("seen", F.count("*").over(Window.partitionBy(*KEY))).where(F.col("seen") >= LEAST_SEEN)
    core = members.where("membership = 'core'").select(*PATTERN, "day", F.lit(True).alias("own"))
    scopes = F.when(is_rest_day(F.col("day")), F.array(F.lit("sleep_day"))).otherwise(F.array(F.lit("sleep_day"), F.lit("work")))
    whole = Window.partitionBy(*KEY)
    asked = [F.struct(F.col(m).cast("double").alias("own"), F.count(m).over(whole).alias("known"), F.percentile(m, 0.6).over(whole).alias("bar")).alias(f"_{m}") for m in measures]
    seen = seen.select(*KEY, "day", "settling", "disruption", *asked)
    nights = seen.withColumn("scope", F.explode(scopes))
    sides = nights.join(core.select(*PATTERN).distinct(), KEY).join(core, [*PATTERN, "day"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    w = Window.partitionBy(*PATTERN, "scope")
    own = F.col("own")
    middle = lambda m, side: F.percentile(F.when(side, F.col(m)), 0.5).over(w)
    rows = sides.withColumns({"own_settling": middle("settling", own), "other_settling": middle("settling", ~own), "own_disruption": middle("disruption", own), "other_disruption": middle("disruption", ~own)})
    joint = (F.col("settling") >= F.least(F.lit(90.0), F.col("other_settling") + 5)) & (F.col("disruption") >= F.col("other_disruption") + 1)
    medians = ["own_settling", "other_settling", "own_disruption", "other_disruption"]
    g = rows.withColumn("joint", F.coalesce(joint, F.lit(False))).groupBy(*PATTERN, "scope").agg(
        F.count_if("own").alias("pattern_days"), F.count_if(~own).alias("comparison_days"), F.count_if(own & F.col("joint")).alias("support"), F.count_if(~own & F.col("joint")).alias("comparison_support"),
        *(F.first(m).alias(m) for m in medians),
        *(clause(F.when(own & F.col("joint"), F.col(f"_{m}.own")), own & F.col("joint"), F.col(f"_{m}.known"), F.col(f"_{m}.bar")).alias(f"high_{m}") for m in measures),
    )
    n, m, s = F.col("pattern_days"), F.col("comparison_days"), F.col("support")
    share = F.when(n > 0, s / n)
    contrast = share - F.when(m > 0, F.col("comparison_support") / m)
    g = g.withColumns({
        "share": share, "contrast": contrast, "confidence": clamp((1 - F.exp(-s / 4)) * (1 - F.exp(-m / 5)) * (0.58 + 0.42 * clamp(contrast))), "strength": clamp(contrast / 0.6),
        "settling_difference": half_up(F.col("own_settling") - F.col("other_settling")), "disruption_difference": half_up(F.col("own_disruption") - F.col("other_disruption")),
    })
    least = F.when(F.col("scope") == "work", LEAST_SHARE["work"]).otherwise(LEAST_SHARE["sleep_day"])
    shown = (n >= 5) & (m >= 3) & (s >= 3) & (F.col("share") >= least) & (F.col("contrast") >= 0.15) & (F.col("confidence") >= 0.28) & (F.col("settling_difference") >= 5) & (F.col("disruption_difference") >= 1)
    first = F.row_number().over(Window.partitionBy(*PATTERN).orderBy(F.desc("shown"), F.desc("scope"))) == 1
    limited = ~reduce(lambda x, y: x & y, [F.col(f"high_{m}") for m in measures], F.lit(bool(measures)))
    out = g.withColumns({"shown": F.coalesce(shown, F.lit(False)), "late": F.coalesce(F.col("own_settling") >= 90, F.lit(False)), "limited": limited})
    return out.withColumn("chosen", first & F.col("shown")).drop(*medians)


def with_calendar(insights: DataFrame, associations: DataFrame) -> DataFrame:
    """Chosen insights with calendar_id, the id of the pattern's published calendar association, and what rests on inferred work days.

    inferred: the insight is of work nights or carries the calendar's association. adjusted_for: what its comparison is limited to, null for all nights.
    """
    calendar = associations.where("shown AND source = 'calendar'").select(*PATTERN, F.col("definition").alias("calendar_id"))
    work = F.col("scope") == "work"
    return insights.where("chosen").join(calendar, PATTERN, "left").withColumns({"inferred": work | F.col("calendar_id").isNotNull(), "adjusted_for": F.when(work, "inferred_rest_day")})


def statement(measures: dict[str, str] | None = None) -> Column:
    """One sentence or more about a row of with_calendar(). measures: the words for each further measure of signals()."""
    n = lambda c: F.col(c).cast("string")
    nights = F.when(F.col("scope") == "work", "inferred work nights").otherwise("nights")
    late = F.concat(n("settling_difference"), F.when(F.col("late"), F.lit(" minutes or more")).otherwise(F.lit(" minutes")))
    more = F.concat(n("disruption_difference"), F.when(F.col("disruption_difference") == 1, F.lit(" interruption")).otherwise(F.lit(" interruptions")))
    first = F.concat(n("support"), F.lit(" of "), n("pattern_days"), F.lit(" "), nights, F.lit(" show both signals; the heart settles "), late, F.lit(" later, with "), more, F.lit(" more."))
    others = [F.when(F.col(f"high_{m}"), F.lit(f" {words} is high as well.")).otherwise("") for m, words in (measures or {}).items()]
    before = F.when(F.col("calendar_id") == "before_inferred_work_day", " Mostly before inferred work days.").when(F.col("calendar_id").isNotNull(), " Mostly before inferred rest days.").otherwise("")
    return F.concat(first, *others, before)


def association_statement() -> Column:
    """A sentence about a published association."""
    n = lambda c: F.col(c).cast("string")
    return F.concat(F.lit("More often with "), F.regexp_replace("definition", "_", " "), F.lit(": "), n("a"), F.lit(" of "), (F.col("a") + F.col("b")).cast("string"), F.lit(" nights, else "), n("c"), F.lit(" of "), n("comparison"), F.lit("."))


def leads(patterns: DataFrame, insights: DataFrame, associations: DataFrame, measures: dict[str, str] | None = None) -> DataFrame:
    """(pattern, id, source, statement) of what a card says first of each of the patterns: its insight, else its strongest association, else nothing (nulls).

    insights: rows of with_calendar(). The strongest is that of the greatest product of confidence and strength, equal ones by id.
    """
    first = insights.select(*PATTERN, F.concat(F.lit("signals_"), "scope").alias("id"), F.lit("signals").alias("source"), statement(measures).alias("statement"), F.lit(1.0).alias("weight"), F.lit(0).alias("kind"))
    rest = associations.where("shown").select(*PATTERN, F.col("definition").alias("id"), "source", association_statement().alias("statement"), F.round(F.col("confidence") * F.col("strength"), 9).alias("weight"), F.lit(1).alias("kind"))
    w = Window.partitionBy(*PATTERN).orderBy("kind", F.desc("weight"), "id")
    top = first.unionByName(rest).withColumn("place", F.row_number().over(w)).where("place = 1").select(*PATTERN, "id", "source", "statement")
    return patterns.select(*PATTERN).join(top, PATTERN, "left")


def unfolded(associations: DataFrame, insights: DataFrame) -> DataFrame:
    """Published associations less those that an insight of with_calendar() already carries."""
    folded = insights.select(*PATTERN, F.col("calendar_id").alias("definition"))
    return associations.where("shown").join(folded, [*PATTERN, "definition"], "left_anti")


def united(insights: DataFrame, associations: DataFrame) -> DataFrame:
    """One relation of both: (pattern, id, source, support, comparison, strength, confidence)."""
    first = insights.select(*PATTERN, F.concat(F.lit("signals_"), "scope").alias("id"), F.lit("signals").alias("source"), "support", F.col("comparison_days").alias("comparison"), "strength", "confidence")
    rest = associations.select(*PATTERN, F.col("definition").alias("id"), "source", "support", "comparison", "strength", "confidence")
    return first.unionByName(rest)
