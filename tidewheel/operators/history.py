"""Earlier windows of a person: history without overlap, and replay at a fixed step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import KEY, SPAN


def anchors(days: DataFrame, selected: DataFrame | None = None, most: int = 3, span: int = SPAN) -> DataFrame:
    """(person, selected_end, k, window_end, period_start): windows that end k spans before a selected day, none before the person's first day.

    selected: (person, selected_end); every day of the calendar by default.
    """
    first = days.groupBy("person").agg(F.min("day").alias("first_day"))
    if selected is None:
        selected = days.select("person", F.col("day").alias("selected_end"))
    rows = selected.join(first, "person").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most))))
    rows = rows.withColumn("window_end", F.expr(f"date_sub(selected_end, {span} * k)")).where("window_end >= first_day")
    return rows.select("person", "selected_end", F.col("k").cast("long").alias("k"), "window_end", F.greatest("first_day", F.date_sub("window_end", span - 1)).alias("period_start"))


def history(published: DataFrame, anchored: DataFrame) -> DataFrame:
    """The shown patterns of each anchored window."""
    return anchored.join(published.where("shown"), KEY)


def replay_ends(days: DataFrame, step: int = 14, span: int = SPAN) -> DataFrame:
    """(person, window_end): every step-th day from the first full window on, up to the latest valid day, and that day."""
    w = Window.partitionBy("person").orderBy("day")
    rows = days.withColumns({"at": F.row_number().over(w), "last_valid": F.max(F.when(F.col("valid"), F.col("day"))).over(Window.partitionBy("person"))})
    due = (F.col("at") >= span) & ((F.col("at") - span) % step == 0) & (F.col("day") <= F.col("last_valid"))
    return rows.where(due | (F.col("day") == F.col("last_valid"))).select("person", F.col("day").alias("window_end"))


def replay_windows(published: DataFrame, members: DataFrame, ends: DataFrame) -> DataFrame:
    """A row for each replayed window with valid days: candidates, shown and hidden patterns, core, boundary and unassigned days."""
    kind = lambda k: F.count_if(F.col("membership") == k).alias(k)
    by_day = members.join(ends, KEY, "left_semi").groupBy(*KEY).agg(F.count("*").alias("valid_days"), kind("core"), kind("boundary"), kind("unassigned"))
    by_pattern = published.join(ends, KEY, "left_semi").groupBy(*KEY).agg(F.count("*").alias("candidates"), F.count_if("shown").alias("visible"))
    return by_day.join(by_pattern, KEY, "left").na.fill(0, ["candidates", "visible"]).withColumn("hidden", F.col("candidates") - F.col("visible"))


SOURCES = ("calendar", "exercise", "food", "wellness", "signals")


def replay_totals(replayed: DataFrame, shown: DataFrame, observed: DataFrame) -> DataFrame:
    """One row of counters over replayed windows, their shown patterns and what was observed of those.

    replayed: rows of replay_windows(); observed: (person, window_end, cluster, source).
    """
    a = replayed.agg(
        F.count("*").alias("windows"), F.countDistinct("person").alias("persons"), *(F.count_if(F.col("visible") == k).alias(f"visible_{k}") for k in range(5)),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("valid_days", "core", "boundary", "unassigned")), F.count_if(F.col("boundary") > 0).alias("with_boundary"), F.count_if(F.col("unassigned") > 0).alias("with_unassigned"),
    )
    b = shown.agg(F.count("*").alias("snapshots"))
    c = observed.agg(F.countDistinct(*KEY, "cluster").alias("explained"), F.count("*").alias("observations"), F.countDistinct("person").alias("explained_persons"), *(F.count_if(F.col("source") == s).alias(f"from_{s}") for s in SOURCES))
    return a.crossJoin(b).crossJoin(c)  # three rows, one each
