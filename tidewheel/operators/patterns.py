"""From labelled days to patterns: membership, emergence, confidence and publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp, distance, half_up
from .windows import FEATURES, KEY, SPAN

CLUSTER = [*KEY, "cluster"]


#: Clusters of a window, at most.
MOST = 4


def rule_labels(featured: DataFrame, k: int = 2) -> DataFrame:
    """Labels by rule, for checks without clustering: one cluster, or those in bed before the window's median and the rest."""
    if k == 1:
        return featured.withColumn("cluster", F.lit(0))
    median = F.percentile("bed", 0.5).over(Window.partitionBy(*KEY))
    return featured.withColumn("cluster", F.when(F.col("bed") < median, 0).otherwise(1))


def membership(labelled: DataFrame) -> DataFrame:
    """Days with their nearest robust centre: distance, clarity, membership and weight. cluster becomes the nearest one.

    The at most MOST centres of a window are window aggregates on its days, so no day is joined with a centre.
    """
    w, c = Window.partitionBy(*KEY), Window.partitionBy(*CLUSTER)
    own = [F.col(f) for f in FEATURES]
    rows = labelled.withColumns({f"c{k}": F.array(*(F.percentile(F.when(F.col("cluster") == k, F.col(f)), 0.5).over(w) for f in FEATURES)) for k in range(MOST)})
    each = [F.struct(distance(own, [F.col(f"c{k}")[i] for i in range(9)]).alias("d"), F.lit(k).alias("cluster")) for k in range(MOST)]
    near = F.sort_array(F.filter(F.array(*each), lambda x: x["d"].isNotNull()))
    rows = rows.drop("cluster").withColumn("near", near).drop(*(f"c{k}" for k in range(MOST)))
    d2 = F.get("near", F.lit(1))["d"]
    rows = rows.select("*", F.col("near")[0]["cluster"].alias("cluster"), F.col("near")[0]["d"].alias("d"), d2.alias("d2")).drop("near")
    rows = rows.withColumn("clarity", F.when(F.col("d2").isNull(), 1.0).otherwise((F.col("d2") - F.col("d")) / F.greatest("d2", F.lit(1e-6))))
    rows = rows.withColumn("q", F.percentile("d", F.array(F.lit(0.5), F.lit(0.8), F.lit(0.92))).over(c))
    rows = rows.withColumn("mad", F.percentile(F.abs(F.col("d") - F.col("q")[0]), 0.5).over(c))
    spread = F.greatest(F.lit(0.08), F.col("mad"))
    rows = rows.withColumn("core_limit", F.greatest(F.lit(0.62), F.col("q")[1], F.col("q")[0] + 2.2 * spread))
    rows = rows.withColumn("edge_limit", F.greatest(F.lit(0.92), F.col("q")[2], F.col("q")[0] + 4 * spread, 1.35 * F.col("core_limit")))
    kind = F.when((F.col("d") <= F.col("core_limit")) & (F.col("clarity") >= 0.12), "core").when((F.col("d") <= F.col("edge_limit")) & (F.col("clarity") >= 0.03), "boundary").otherwise("unassigned")
    rows = rows.withColumn("membership", kind)
    weight = F.when(F.col("membership") == "core", 1.0).when(F.col("membership") == "boundary", clamp(0.65 - 0.22 * F.col("d") / F.greatest("edge_limit", F.lit(1e-6)), 0.35, 0.65)).otherwise(0.0)
    return rows.withColumn("weight", weight).drop("q", "mad", "d2", "core_limit", "edge_limit")


def emergence(members: DataFrame, counts: DataFrame) -> DataFrame:
    """Six dimensions, emergence, confidence and effective days of each cluster.

    members: rows of membership(), with the stability of each window's clustering where there is such a column (else 1,
    as for one cluster); counts: (person, window_end, available, valid_days, window_start). Statistics
    of a cluster are window aggregates on its days; one aggregation makes its row; a window's rows see each other.
    """
    c = Window.partitionBy(*CLUSTER)
    members = members if "stability" in members.columns else members.withColumn("stability", F.lit(1.0))
    span = counts.select(*KEY, "available", "valid_days", "window_start", F.greatest(F.lit(1), F.ceil(F.col("available") / 7)).alias("weeks"))
    rows = members.where("membership <> 'unassigned'").join(span, KEY).withColumn("w", F.col("quality") * F.col("weight"))
    rows = rows.withColumn("cores", F.count_if(F.col("membership") == "core").over(c)).withColumn("in_shape", (F.col("cores") < 2) | (F.col("membership") == "core"))
    week = F.floor(F.datediff("day", "window_start") / 7)
    by_week = Window.partitionBy(*CLUSTER, "week").orderBy(F.desc("weight"), "day")
    half_of = lambda order: F.row_number().over(Window.partitionBy(*CLUSTER, "in_shape").orderBy(order))
    rows = rows.withColumn("week", week).withColumns({
        "week_top": F.row_number().over(by_week) == 1, "first": half_of(F.col("day")), "last": half_of(F.desc("day")), "size": F.count_if("in_shape").over(c),
        "centre": F.array(*(F.avg(F.when(F.col("in_shape"), F.col(f))).over(c) for f in FEATURES)),
    })
    own = [F.col(f) for f in FEATURES]
    rows = rows.withColumn("to_centre", F.when(F.col("in_shape"), distance(own, [F.col("centre")[i] for i in range(9)])))
    half = F.greatest(F.lit(2), F.floor(F.col("size") / 2))
    late = F.col("day") >= F.date_sub("window_end", 13)
    mean_of = lambda order, f: F.avg(F.when(F.col("in_shape") & (F.col(order) <= half), F.col(f)))
    g = rows.groupBy(*CLUSTER).agg(
        F.count("*").alias("days"), F.count_if(F.col("membership") == "core").alias("core_days"), F.count_if("in_shape").alias("shape_days"),
        F.least(F.pow(F.sum("w"), 2) / F.greatest(F.lit(1e-6), F.sum(F.col("w") * F.col("w"))), F.sum("w")).alias("n_eff"), F.percentile("bed", 0.5).alias("median_bed"),
        F.percentile("to_centre", F.array(F.lit(0.5), F.lit(0.8))).alias("q"), F.sum(F.when(F.col("week_top"), F.col("weight"))).alias("week_mass"),
        F.sum(F.when(late, F.col("weight")).otherwise(0.0)).alias("recent"), F.sum(F.when(late, 0.0).otherwise(F.col("weight"))).alias("prior"),
        F.array(*(mean_of("first", f) for f in FEATURES)).alias("early"), F.array(*(mean_of("last", f) for f in FEATURES)).alias("later"),
        F.first("centre").alias("centre"), *(F.first(x).alias(x) for x in ("available", "valid_days", "weeks", "stability")),
    )
    apart = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    everyone = F.collect_list(F.struct("cluster", "days", "centre")).over(Window.partitionBy(*KEY))
    g = g.withColumn("others", everyone).withColumn("others", F.filter("others", lambda o: (o["cluster"] != F.col("cluster")) & (o["days"] >= 3)))
    nearest = F.coalesce(F.array_min(F.transform("others", lambda o: apart(F.col("centre"), o["centre"]))), F.lit(1.05))
    structural = F.when(F.col("shape_days") >= 2, F.exp(-0.65 * apart(F.col("early"), F.col("later")))).otherwise(0.72)
    weeks, q = F.col("weeks"), F.col("q")
    g = g.withColumns({"nearest": nearest, "structural": structural}).withColumns({
        "support": 1 - F.exp(-F.col("n_eff") / 5),
        "recurrence": clamp(F.col("week_mass") / weeks * (0.52 + 0.48 * clamp((weeks - 1) / 4)), 0.05),
        "compactness": clamp(F.exp(-(0.72 * q[0] + 0.32 * q[1])), 0.05),
        "separation": clamp(F.col("nearest") / (F.col("nearest") + q[1] + 0.08), 0.05),
        "temporal_stability": clamp(F.col("structural") * (0.52 + 0.48 * clamp(weeks / 4)), 0.05),
    })
    expected = F.greatest(F.lit(2.0), F.col("prior") / F.greatest(F.lit(1), weeks - 2) * 2)
    g = g.withColumn("recent_continuity", clamp(F.col("recent") / expected * (0.75 + 0.25 * F.col("compactness")), 0.05))
    parts = (("support", 0.2), ("recurrence", 0.2), ("compactness", 0.2), ("separation", 0.2), ("temporal_stability", 0.1), ("recent_continuity", 0.1))
    log = sum((w * F.log(F.greatest(F.col(x), F.lit(0.05))) for x, w in parts), F.lit(0.0))
    sure = (0.46 + 0.38 * clamp(weeks / 6) + 0.16 * F.col("valid_days") / F.col("available")) * (0.7 + 0.3 * F.col("compactness")) * (0.72 + 0.28 * F.col("stability"))
    return g.select(*CLUSTER, "days", "core_days", "shape_days", "n_eff", "median_bed", *(x for x, _ in parts), half_up(100 * F.exp(log)).alias("emergence"), half_up(100 * clamp(sure, 0.05)).alias("confidence"))


def published(patterns: DataFrame) -> DataFrame:
    """With status (70, 55), rank by median bed and whether the pattern is shown."""
    e = F.col("emergence")
    shown = (F.col("core_days") >= 4) & (F.col("n_eff") >= 4) & (e >= 55) & (F.col("confidence") >= 55)
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("median_bed", "cluster")).cast("long")
    return patterns.withColumns({"status": F.when(e >= 70, "clear").when(e >= 55, "emerging").otherwise("early"), "shown": shown, "rank": rank})


def window_counts(days: DataFrame, span: int = SPAN) -> DataFrame:
    """(person, window_end, available, valid_days, window_start)."""
    w = Window.partitionBy("person").orderBy(F.unix_date("day")).rangeBetween(1 - span, 0)
    return days.select("person", F.col("day").alias("window_end"), F.count("*").over(w).alias("available"), F.count_if("valid").over(w).alias("valid_days"), F.min("day").over(w).alias("window_start"))
