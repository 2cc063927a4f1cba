"""Structured Streaming forms of keyed maintenance, and their batch equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.stores import never_shrink, newest, write


def gate_schedule(requests: DataFrame, keys: list[str], at: str, gap: int, ties: list[str]) -> DataFrame:
    """Requests with start: each at its own time or ``gap`` after the one before of its keys, whichever is later.

    The recurrence is a running maximum of the times less gap times position.
    """
    w = Window.partitionBy(*keys).orderBy(at, *ties)
    n = F.row_number().over(w) * gap
    return requests.withColumn("__n", n).withColumn("start", F.max(F.col(at) - F.col("__n")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__n")).drop("__n")


def debounced(events: DataFrame, keys: list[str], at: str, gap: int, ties: list[str]) -> DataFrame:
    """Events that none of the same keys follows within ``gap``."""
    w = Window.partitionBy(*keys).orderBy(at, *ties)
    following = F.lead(at).over(w)
    return events.withColumn("__next", following).filter(F.col("__next").isNull() | (F.col("__next") - F.col(at) >= gap)).drop("__next")


def debounced_stream(events: DataFrame, keys: list[str], at: str, gap: str, late: str) -> DataFrame:
    """The same on a stream: the last time of each session of events less than ``gap`` apart, once the watermark has passed it."""
    return events.withWatermark(at, late).groupBy(*keys, F.session_window(at, gap).alias("session")).agg(F.max(at).alias(at)).drop("session")


def first_in_flight(requests: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """The first request of each key while others of it arrive within the watermark."""
    return requests.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def with_expiry(responses: DataFrame, complete: Column, at: str, whole: int, part: int) -> DataFrame:
    """Responses with expires: ``whole`` or ``part`` milliseconds after their time."""
    return responses.withColumn("expires", F.col(at) + F.when(complete, whole).otherwise(part))


def windowed_counts(events: DataFrame, at: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Events per window of event time; a window's row is final when the watermark has passed its end."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def merge_batch(batch: DataFrame, path: str, keys: list[str], at: str, by: str = "book_id", grows_only: bool = False) -> None:
    """Merge a batch into a Parquet table with a folder for each value of ``by`` (one of the keys). Only folders of values that the batch has are read and written.

    Of rows of one key that with the largest ``at`` stays, of equal ones that with the largest other values, or with ``grows_only`` the one that
    ``stores.never_shrink`` takes. Merging a batch once more changes nothing, so one that was cut short can be run again.
    """
    spark = batch.sparkSession
    new = newest(batch, keys, at)
    old = table(spark, path, batch.schema)
    if old is None:
        return write(new, path, by)
    touched = old.join(F.broadcast(new.select(by).distinct()), by, "left_semi").select(*batch.columns)
    return write(never_shrink(touched, new, keys) if grows_only else newest(touched.unionByName(new), keys, at), path, by)


def maintain(updates: DataFrame, path: str, keys: list[str], at: str, checkpoint: str, by: str = "book_id", grows_only: bool = False) -> StreamingQuery:
    """Keep a keyed table up to date from a stream, batch by batch (see ``merge_batch``)."""
    return updates.writeStream.foreachBatch(lambda batch, _: merge_batch(batch, path, keys, at, by, grows_only)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """What ``merge_batch`` has written; None if there is nothing yet."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own):
        return None
    return spark.read.schema(schema).parquet(path)
