"""The event table as invocation counts, duration summaries and memory samples of functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01"
HOURS = 720
TRIGGERS = ("click", "error", "purchase", "signup", "view")
MEMORY_DAYS = 24


def events_path(sf_dir: str) -> str:
    return f"{sf_dir}/events.parquet"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their trace day, hour of day and function key."""
    raw = spark.read.parquet(events_path(sf_dir))
    day = F.datediff(F.to_date("ts"), F.lit(EPOCH).cast("date")) + 1
    return raw.select(
        day.cast("int").alias("trace_day"), F.hour("ts").cast("int").alias("hour_of_day"), F.minute("ts").alias("minute"),
        (F.col("user_id") % 10).alias("HashOwner"), F.col("user_id").alias("HashApp"), F.col("event_type").alias("HashFunction"),
        F.col("event_type").alias("Trigger"), "event_id", "value", "props",
    )


FUNCTION = ("trace_day", "HashOwner", "HashApp", "HashFunction")


def invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls per function and hour."""
    hour = ((F.col("trace_day") - 1) * 24 + F.col("hour_of_day")).cast("int").alias("hour_index")
    return events(spark, sf_dir).groupBy(*FUNCTION, "Trigger", hour).agg(F.count("*").alias("calls"))


def minute_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per function and day with a map of its minute counts.

    Most functions have events in few of the 1,440 minutes. An array of all of
    them, looked up in this map, costs 1,440 maps a row: the optimizer copies
    the map's making into the lookup of every minute.
    """
    at = (F.col("hour_of_day") * 60 + F.col("minute")).alias("at")
    calls = events(spark, sf_dir).groupBy(*FUNCTION, "Trigger", at).agg(F.count("*").cast("double").alias("n"))
    return calls.groupBy(*FUNCTION, "Trigger").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("minutes"))


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two partial summaries per function and day; every seventh application has none."""
    rows = events(spark, sf_dir).where("HashApp % 7 != 0")
    return rows.groupBy(*FUNCTION, (F.col("event_id") % 2).alias("part")).agg(
        F.avg("value").alias("Average"), F.count("*").alias("Count")
    )


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where(F.col("trace_day") <= MEMORY_DAYS)
    return rows.select(
        "trace_day", "HashOwner", "HashApp", (F.col("event_id") % 5 + 1).alias("SampleCount"),
        F.get_json_object("props", "$.k").cast("double").alias("AverageAllocatedMb"),
    )


def vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TRIGGERS], "Trigger string")
