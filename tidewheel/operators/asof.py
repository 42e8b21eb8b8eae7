"""Values of irregular series at given instants: the neighbours before and after are found by one sort of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interpolated(points: DataFrame, series: DataFrame, by: list[str], at: str = "at", value: str = "value") -> DataFrame:
    """points (by, at, ...) with value, linear between the neighbours in series (by, at, value); the ends go on, a key without a series gets 0.

    Points and series are united and sorted by key and instant; a frame up to a row has the neighbour before, and in the reverse order that after. Both frames grow by a
    row at a time, where one that ends with the key would be read anew for each row. An instant that the series has takes its value; of several values at one instant the least comes first. Rows of the series without an instant or value are passed over.
    """
    rest = [c for c in points.columns if c not in (*by, at)]
    none = F.lit(None).cast("struct<at: double, value: double>")
    asked = points.select(*by, F.col(at).cast("double").alias("_at"), F.struct(F.col(at), *rest).alias("_row"), none.alias("_known"), F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("_value"))
    known = series.where(F.col(at).isNotNull() & F.col(value).isNotNull()).select(*by, F.col(at).cast("double").alias("_at"), F.col(value).cast("double").alias("_value"))
    known = known.select(*by, "_at", F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), F.struct(F.col("_at").alias("at"), F.col("_value").alias("value")).alias("_known"), F.lit(1).alias("_kind"), "_value")
    order = Window.partitionBy(*by).orderBy("_at", "_kind", "_value")
    left = F.last("_known", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*by).orderBy(F.desc("_at"), F.desc("_kind"), F.desc("_value"))
    right = F.last("_known", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    rows = asked.unionByName(known).select(*by, "_at", "_row", "_kind", left.alias("l"), right.alias("r")).where("_kind = 0")
    mix = (F.col("_at") - F.col("l.at")) / F.greatest(F.lit(1e-6), F.col("r.at") - F.col("l.at"))
    between = F.when(F.col("l").isNull(), F.col("r.value")).when(F.col("r").isNull(), F.col("l.value")).otherwise(F.col("l.value") * (1 - mix) + F.col("r.value") * mix)
    return rows.select(*by, "_row.*", F.coalesce(between, F.lit(0.0)).alias(value))
