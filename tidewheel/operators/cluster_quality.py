"""How good given labels are, relationally: silhouettes from pairs of days of a window, agreement of two labelings from their contingency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import distance, pairs_of
from .windows import FEATURES, KEY


def silhouette(labelled: DataFrame, label: str = "cluster", features: list[str] = FEATURES) -> DataFrame:
    """(person, window_end, days, clusters, silhouette) of labelled days of windows (person, window_end, day, label, features).

    A day meets the at most 41 others of its window by the window's key. It counts 0 where it is alone in its cluster or equals its surroundings; a window of
    one cluster has no silhouette (null), for there is no other cluster to be near to.
    """
    rows = labelled.select(*KEY, "day", F.col(label).alias("label"), *features)
    other = rows.select(*KEY, F.col("day").alias("other_day"), F.col("label").alias("other"), *(F.col(f).alias(f"o_{f}") for f in features))
    pairs = rows.join(other, KEY).where("day <> other_day")
    means = pairs.groupBy(*KEY, "day", "label", "other").agg(F.avg(distance([F.col(f) for f in features], [F.col(f"o_{f}") for f in features])).alias("mean"))
    own = F.col("label") == F.col("other")
    sides = means.groupBy(*KEY, "day").agg(F.max(F.when(own, F.col("mean"))).alias("within"), F.min(F.when(~own, F.col("mean"))).alias("nearest"))
    most = F.greatest("within", "nearest")
    score = F.when(F.col("within").isNull() | (most == 0), 0.0).otherwise((F.col("nearest") - F.col("within")) / most)
    g = rows.join(sides, [*KEY, "day"], "left").groupBy(*KEY).agg(F.count("*").alias("days"), F.countDistinct("label").alias("clusters"), F.avg(score).alias("score"))
    return g.select(*KEY, "days", "clusters", F.when(F.col("clusters") > 1, F.col("score")).alias("silhouette"))


def agreement(labelled: DataFrame, left: str, right: str, by: list[str] = KEY) -> DataFrame:
    """(by, n, agreement): adjusted Rand index of two labels of the rows of each group; 1 where chance leaves no room.

    Only counts of label pairs are formed, so a group may have any number of rows. A row without a label in either column is left out.
    """
    cells = labelled.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(*by, left, right).agg(F.count("*").alias("n"))

    def pairs(keys: list[str], name: str) -> DataFrame:
        return cells.groupBy(*by, *keys).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(pairs_of(F.col("n"))).alias(name))

    every = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(pairs_of(F.col("n"))).alias("both"))
    g = every.join(pairs([left], "rows"), by).join(pairs([right], "columns"), by)
    total = pairs_of(F.col("n"))
    expected: Column = F.when(total > 0, F.col("rows") * F.col("columns") / total).otherwise(0.0)
    most = (F.col("rows") + F.col("columns")) / 2
    return g.select(*by, "n", F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected)).alias("agreement"))
