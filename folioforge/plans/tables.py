"""Tables of the driver that several registered queries read, and SQL for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in milliseconds."""
    return table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


EVENTS_SQL = "SELECT *, epoch_us(ts) // 1000 AS ms FROM events"
NOW = 1_704_200_000_000
