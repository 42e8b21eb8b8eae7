from pyspark.sql import functions as F

from tidewheel.llm.common import HOT_ROWS, salted_join, written


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows(spark, hot):
    """3,000 rows over 300 keys, or most of them on one; one key is null, and few lacks some keys."""
    key = F.when(F.col("id") == 0, None).otherwise(F.when(F.lit(hot) & (F.col("id") % 4 > 0), 7).otherwise(F.col("id") % 300))
    many = spark.range(3000).select(key.alias("k"), F.col("id").alias("x"))
    few = spark.range(0, 300, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("y")).unionAll(spark.createDataFrame([(7, 70), (7, 71)], "k long, y long"))
    return many, few


def same(joined, many, few):
    return sorted(map(tuple, joined.select("k", "x", "y").collect())) == sorted(map(tuple, many.join(few, "k").select("k", "x", "y").collect()))


def test_keys_without_crowds_join_plainly(spark):
    many, few = rows(spark, False)
    joined = salted_join(many, few, "k", "x")
    assert "_salt" not in plan(joined) and "ResolvedHint" not in plan(joined) and "broadcast" not in plan(joined)
    assert same(joined, many, few)


def test_sizes_given_join_plainly(spark):
    many, few = rows(spark, False)
    sizes = written(many.groupBy("k").agg(F.count("*").alias("n")), "sizes")
    joined = salted_join(many, few, "k", "x", sizes=sizes)
    assert "_salt" not in plan(joined)
    assert same(joined, many, few)


def test_hot_keys_are_still_dealt(spark):
    many, few = rows(spark, True)
    assert many.where("k = 7").count() > HOT_ROWS
    joined = salted_join(many, few, "k", "x")
    assert "_salt" in plan(joined)
    assert same(joined, many, few)


def test_empty_sides(spark):
    many, few = rows(spark, False)
    assert salted_join(many.limit(0), few, "k", "x").isEmpty()
    assert salted_join(many, few.limit(0), "k", "x").isEmpty()
