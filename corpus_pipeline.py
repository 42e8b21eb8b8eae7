"""The corpus pipeline: language, near copies, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import decontaminate, language_id, near_dedup, packing, secret_scan


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined stay; those without text, without a letter or without a likely language go.

    Repeated rows and null ids are judged like all others; an empty table stays empty; long texts are read whole.
    """
    return language_id.accepted(docs, language_id.train(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies stays; rows without an id, without words or of texts of their own stay.

    Rows are told apart by id and text: of an id with several texts each is judged by itself, and of rows equal in both one
    stays, the least in its other columns. An empty table stays empty; texts may be of any length.
    """
    found = near_dedup.near_duplicates(docs)
    own = (F.col("doc_id").cast("long") == F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("text_hash"))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_id"), "text_hash").distinct()
    stay = docs.join(gone, own, "left_anti").select(docs.columns)
    key = [F.col("doc_id"), F.xxhash64("text")]
    if docs.where(F.col("doc_id").isNotNull()).groupBy(*key).count().where("count > 1").isEmpty():
        return stay
    named = stay.where(F.col("doc_id").isNotNull()).groupBy(*key).agg(F.min(F.struct(*stay.columns)).alias("row")).select("row.*")
    return named.unionByName(stay.where(F.col("doc_id").isNull()))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go, and with one all rows of its id; null ids, null and empty texts stay.

    Texts are searched whole; an empty table or benchmark takes nothing away.
    """
    hits = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(hits.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every row stays, null and empty texts as they are. n_chars follows the text."""
    clean = secret_scan.redacted(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row for each piece of a document; a null or empty text is its end token alone."""
    return packing.pack(packing.pieces(docs))


STAGES = [("language_id", language), ("near_dedup", near_copies), ("decontaminate", benchmark_leaks), ("secret_scan", secrets), ("packing", pack)]
#: Trained models and a tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES one after another over documents; what each keeps is a table that the next one reads."""
    from tidewheel.llm.common import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
