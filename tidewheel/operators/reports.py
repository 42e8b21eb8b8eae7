"""Reports as relations of lines: figures, then a table of the strongest rows, ready to be written as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import half_up

#: Rows of a table.
ROWS = 12


def figures(counts: DataFrame, words: dict[str, str]) -> DataFrame:
    """(part, place, line): a line for each named column of a one-row relation, in the order of the names."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.concat(F.lit(f"- {text}: "), F.col(c).cast("string")).alias("line")) for i, (c, text) in enumerate(words.items()))))
    return counts.select(each.alias("x")).select(F.lit(1).alias("part"), "x.*")


def lines_of(rows: DataFrame, order: list[Column], cells: list[Column], heads: list[str], part: int = 2, n: int = ROWS) -> DataFrame:
    """(part, place, line): a head, a rule and the first n rows as lines of a table. The n first rows are a top-k, found before they are numbered."""
    spark = rows.sparkSession
    first = rows.orderBy(*order).limit(n).select(F.row_number().over(Window.orderBy(*order)).alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(c.cast("string"), F.lit("")) for c in cells)), F.lit(" |")).alias("line"))
    head = spark.createDataFrame([(-1, "| " + " | ".join(heads) + " |"), (0, "|" + "-|" * len(heads))], "place int, line string")
    return head.unionByName(first).select(F.lit(part).alias("part"), "place", "line")


def report(title: str, *parts: DataFrame) -> DataFrame:
    """(part, place, line) of a title and parts. A report has some dozens of lines, whatever it is about."""
    spark = parts[0].sparkSession
    out = spark.createDataFrame([(0, 0, f"# {title}")], "part int, place int, line string")
    for p in parts:
        out = out.unionByName(p)
    return out


def fixed(x: Column, digits: int = 0) -> Column:
    """x with so many digits, halves up; what differs only behind six more digits is equal."""
    return F.format_string(f"%.{digits}f", half_up(F.round(x * 10**digits, 6)) / 10**digits)


def percent(x: Column, digits: int = 0) -> Column:
    return fixed(x * 100, digits)


def associations_report(totals: DataFrame, strongest: DataFrame) -> DataFrame:
    """The replay's figures and its strongest observations. totals: history.replay_totals(); strongest: (pattern, id, source, support, strength, confidence)."""
    words = {
        "windows": "windows", "persons": "persons", **{f"visible_{k}": f"windows with {k} shown patterns" for k in range(5)}, "snapshots": "shown patterns", "explained": "of them with an observation",
        "observations": "observations", "from_calendar": "of the calendar", "from_exercise": "of exercise", "from_food": "of food", "from_wellness": "of wellness", "from_signals": "of joint signals",
        "valid_days": "valid days", "core": "core days", "boundary": "boundary days", "unassigned": "unassigned days",
    }
    order = [F.desc(F.round(F.col("strength") * F.col("confidence"), 9)), F.col("person"), F.col("window_end"), F.col("cluster"), F.col("id")]
    cells = [F.col("person"), F.col("window_end"), F.col("cluster"), F.regexp_replace("id", "_", " "), F.col("support"), percent(F.col("strength")), percent(F.col("confidence"))]
    return report("Context of patterns", figures(totals, words), lines_of(strongest, order, cells, ["person", "window end", "pattern", "context", "support", "strength", "confidence"]))


def cycles_report(features: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Counts of tested series and the strongest cycles of features and, where given, of patterns.

    features: (series, period, explained, p, q, split_stable, publishable); patterns: the same with person, window_end, pattern_id and replicated.
    """
    words = {"tested": "series tested", "nominal": "p of 0.05 or less", "discovered": "q of 0.1 or less", "publishable": "publishable"}
    count = lambda df: df.agg(F.count("*").alias("tested"), F.count_if(F.col("p") <= 0.05).alias("nominal"), F.count_if(F.col("q") <= 0.1).alias("discovered"), F.count_if("publishable").alias("publishable"))
    order = [F.col("p"), F.desc(F.round("explained", 9)), F.col("series")]
    shares = [F.col("period"), F.concat(percent(F.col("explained"), 1), F.lit("%")), fixed(F.col("p"), 4), fixed(F.col("q"), 3)]
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
    parts = [figures(count(features), words), lines_of(features, order, [F.col("series"), *shares, yes("split_stable")], ["series", "days", "explained", "p", "q", "both halves"])]
    if patterns is not None:
        named = [F.col("person"), F.col("window_end"), F.col("pattern_id"), *shares, yes("replicated")]
        parts += [figures(count(patterns), {k: f"patterns: {v}" for k, v in words.items()}).withColumn("part", F.lit(3)), lines_of(patterns, order, named, ["person", "window end", "pattern", "days", "explained", "p", "q", "again elsewhere"], part=4)]
    return report("Cycles", *parts)


def write_text(lines: DataFrame, path: str) -> None:
    """A report as one text file: its few lines are one task's."""
    lines.coalesce(1).sortWithinPartitions("part", "place").select("line").write.mode("overwrite").text(path)
