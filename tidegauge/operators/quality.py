"""The quality record of a build: all metrics from one pass over each source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import number
from tidegauge.operators.demand import hourly_totals, on_grid, reconciled_with
from tidegauge.schema import FUNCTION_KEY
from tidegauge.sources.shared import materialize

APP_KEY = ("trace_day", "HashOwner", "HashApp")


def _whole(keys: tuple[str, ...]):
    return reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))


def source_panel(invocations: DataFrame, durations: DataFrame) -> DataFrame:
    """Counters per hour and trigger from which every invocation and duration metric is a sum.

    Both sources are shuffled once, by function and day: the mark of a
    function's first row of a day, the sums of its durations and their join
    share that partitioning. Durations without an invocation stand in a row
    without hour and trigger. Invalid averages count as rows, but have no
    weight.
    """
    first = F.row_number().over(Window.partitionBy(*FUNCTION_KEY).orderBy("hour_index")) == 1
    average = number(F.col("Average"))
    valid = average.isNotNull() & (average >= 0)
    days = durations.groupBy(*FUNCTION_KEY).agg(
        F.count("*").alias("rows"),
        F.try_divide(F.sum(F.when(valid, average * F.col("Count"))), F.sum(F.when(valid, F.col("Count")))).alias("average_ms"),
    )
    both = invocations.withColumn("first", first).join(days, list(FUNCTION_KEY), "full")
    calls, rows, matched = F.col("calls"), F.col("rows"), F.col("average_ms").isNotNull()
    once = F.coalesce("first", F.lit(True))  # of the rows that carry a function's durations, one counts
    return both.groupBy("trace_day", "hour_index", "Trigger").agg(
        F.count("first").alias("invocation_rows"),
        F.sum(calls).alias("invocations"),
        F.sum(F.when(matched, calls * F.col("average_ms") / 1000.0)).alias("compute_seconds"),
        F.sum(F.when(matched, calls)).alias("matched"),
        F.count_if(calls > 0).alias("active_functions"),
        F.count_if(F.col("first")).alias("function_days"),
        F.count_if(F.col("first") & ~matched).alias("missing_functions"),
        F.coalesce(F.sum(F.when(~matched, calls)), F.lit(0)).alias("missing_invocations"),
        F.coalesce(F.sum(F.when(once, rows)), F.lit(0)).alias("duration_rows"),
        F.coalesce(F.sum(F.when(once & (rows > 1), rows)), F.lit(0)).alias("duplicate_rows"),
        F.count_if(once & (rows > 1) & _whole(FUNCTION_KEY)).alias("duplicate_groups"),
    )


def memory_days(memory: DataFrame) -> DataFrame:
    """Rows, rows of repeated applications and such applications per day, from one pass."""
    n = F.col("n")
    apps = memory.groupBy(*APP_KEY).agg(F.count("*").alias("n"))
    return apps.groupBy("trace_day").agg(
        F.sum("n").alias("memory_rows"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("duplicate_rows"),
        F.count_if((n > 1) & _whole(APP_KEY)).alias("duplicate_groups"),
    )


def quality_record(
    invocations: DataFrame, durations: DataFrame, memory: DataFrame, triggers: DataFrame, names: list[str], hours: int, sources: dict[str, tuple[str, int]]
) -> DataFrame:
    """One row of 32 metrics: layouts and files, days and rows read, missing durations, repeated keys, output and reconciliation.

    ``sources`` gives (layout, files) of invocation, duration and memory.
    Empty sources count 0 and have null percentages; rows outside the grid
    raise. The panel and the days of memory are stored first: they are as
    small as the calendar and the vocabulary.
    """
    panel = materialize(source_panel(invocations, durations), "quality-panel")
    days = materialize(memory_days(memory), "memory-days")
    sums = ("invocations", "compute_seconds", "matched", "active_functions")
    observed = panel.where("invocation_rows > 0").groupBy("hour_index", "Trigger").agg(*(F.sum(c).alias(c) for c in sums))
    demand = on_grid(observed, triggers, hours)
    totals = hourly_totals(demand, names)

    def total(column: str):
        return F.coalesce(F.sum(column), F.lit(0)).cast("long")

    def distinct_days(rows: str):
        return F.countDistinct(F.when(F.col(rows) > 0, F.col("trace_day"))).cast("long")

    inputs = panel.agg(
        distinct_days("invocation_rows").alias("invocation_processed_day_count"),
        distinct_days("duration_rows").alias("duration_processed_day_count"),
        total("invocation_rows").alias("invocation_source_row_count"),
        total("duration_rows").alias("duration_source_row_count"),
        total("missing_functions").alias("missing_duration_join_function_count"),
        F.try_divide(F.lit(100.0) * F.sum("missing_functions"), F.sum("function_days")).alias("missing_duration_join_function_percentage"),
        total("missing_invocations").alias("missing_duration_join_invocation_count"),
        F.try_divide(F.lit(100.0) * F.sum("missing_invocations"), F.sum("invocations")).alias("missing_duration_join_invocation_percentage"),
        total("duplicate_rows").alias("duration_duplicate_row_count"),
        total("duplicate_groups").alias("duration_duplicate_key_group_count"),
    )
    calendar = F.sequence(F.lit(1), F.lit(hours // 24))
    samples = days.agg(
        distinct_days("memory_rows").alias("memory_processed_day_count"),
        total("memory_rows").alias("memory_source_row_count"),
        F.count("*").cast("long").alias("daily_memory_row_count"),
        total("duplicate_rows").alias("memory_duplicate_row_count"),
        total("duplicate_groups").alias("memory_duplicate_key_group_count"),
        F.array_join(F.array_except(calendar, F.collect_set(F.col("trace_day").cast("int"))).cast("array<string>"), "|").alias("memory_unavailable_trace_days"),
    )
    output = totals.agg(
        F.count("*").cast("long").alias("hourly_total_row_count"),
        total("total_invocations").alias("total_invocations"),
        F.sum("total_compute_seconds").alias("total_compute_seconds"),
    )
    rows = demand.agg(F.count("*").cast("long").alias("hourly_trigger_row_count"))
    raw = panel.agg(F.sum("invocations").alias("_calls"), F.sum("compute_seconds").alias("_seconds"))
    parts = [samples, rows, output, reconciled_with(raw, demand, totals)]
    one = reduce(lambda a, b: a.join(b, F.lit(True)), parts, inputs)  # single rows side by side
    files = {f"{k}_source_layout": F.lit(layout) for k, (layout, _) in sources.items()}
    return one.withColumns({**files, **{f"{k}_source_file_count": F.lit(n).cast("long") for k, (_, n) in sources.items()}})
