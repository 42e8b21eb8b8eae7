"""Connected components of links by alternating large and small stars; every step is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, salted_join, written


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """Hangs each node's neighbours on its least one. both: larger neighbours go there (large star), else smaller ones and the node.

    A written table. A node of very many neighbours is dealt over several tasks.
    """
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        near = near.unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = written(near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "least")
    joined = salted_join(near, least.select("u", "m"), "u", "v", sizes=least.select("u", "n"))
    if both:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    stars = written(out.where("a <> b").distinct(), "edges")
    drop_written(least)
    return stars


def _hang_on_roots(edges: DataFrame) -> bool:
    """Whether each node has one edge to a lesser node at most, and those that edges go to have none: then b is the root of a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ups = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.max("down").alias("down"))
    return not ups.agg(F.count_if((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("down") > 0)))).first()[0]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root), root the least node reachable, for each node of a link. Null ends and loops are no links."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = written(links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "edges")
    while not _hang_on_roots(edges):
        mid = _stars(edges, True)
        drop_written(edges)
        edges = _stars(mid, False)
        drop_written(mid)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
