"""Hourly event counts as a stream: an extension, equal to the batch aggregate."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.sources.shared import delete_on_exit, shared_dir

STATE = "hour timestamp, event_type string, events bigint, batch bigint, day date"


def partial_counts(events: DataFrame) -> DataFrame:
    """Mergeable counts of some of the events by hour and type: those of all parts of a table add up to those of the table."""
    rows = events.select(F.date_trunc("HOUR", F.col("ts").cast("timestamp")).alias("hour"), "event_type")
    return rows.groupBy("hour", "event_type").agg(F.count("*").alias("events"))


def add_part(events: DataFrame, state: str, batch: int) -> None:
    """Write the counts of one batch beside those of the others, by day. Writing a batch again replaces it, so a retry counts once."""
    days = partial_counts(events).withColumn("day", F.to_date("hour"))
    days.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{state}/batch={batch}")


def merged(spark: SparkSession, state: str, since: str | None = None) -> DataFrame:
    """Counts of all batches; with ``since`` (a date), folders of earlier days are pruned, not read. No batch gives no rows."""
    parts = spark.read.schema(STATE).option("basePath", state).parquet(state)
    parts = parts if since is None else parts.where(F.col("day") >= F.lit(since).cast("date"))
    return parts.groupBy("hour", "event_type").agg(F.sum("events").cast("long").alias("events"))


def follow(stream: DataFrame, state: str, checkpoint: str):
    """Add every micro-batch of a stream of events as a part, then stop at the end of what is there.

    Started again with the same checkpoint it reads new files only and adds their parts. Late events need no watermark:
    a part may hold any hours, and nothing is kept in the memory of executors or the driver.
    """
    query = stream.writeStream.foreachBatch(lambda rows, batch: add_part(rows, state, batch))
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table read as a stream to its end: parts in the shared folder, merged when they are read."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    root = f"{shared_dir(spark)}/tidegauge/hourly-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    follow(stream, f"{root}/parts", f"{root}/progress").awaitTermination()
    delete_on_exit(spark, root)
    return merged(spark, f"{root}/parts")
