"""Tables that a query keeps while it runs, in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Only a local session, as in tests, may lack one and gets a folder of its own."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewheel-"))
        there = spark.sparkContext.getCheckpointDir()
    return there.rstrip("/")


def kept(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, for plans that read it more than once. Losing an executor loses nothing."""
    path = f"{scratch_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
