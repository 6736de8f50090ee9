"""Hourly demand from invocation counts, duration summaries and memory samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import fold, number, ratio
from tidegauge.operators.quantiles import grouped_percentiles
from tidegauge.schema import FUNCTION_KEY
from tidegauge.sources.shared import materialize


def normalize_triggers(raw: DataFrame, vocabulary: tuple[str, ...], col: str = "Trigger") -> DataFrame:
    """Adds ``code`` (place in the vocabulary from 0, -1 if unknown) to folded labels."""
    label = fold(F.col(col))
    code = F.coalesce(F.array_position(F.array(*map(F.lit, vocabulary)), label) - 1, F.lit(-1))
    return raw.withColumn(col, label).withColumn("code", code.cast("int"))


def minutes_to_hours(wide: DataFrame, minutes: str = "minutes") -> DataFrame:
    """One row per hour of day from a row of minute counts: the reshape happens before any join.

    The counts are an array of 1,440, or a map from the minute of the day (0 to
    1,439; another raises) to its count, without the minutes that have none.
    """

    def hour_sum(h: Column) -> Column:
        return F.aggregate(F.slice(minutes, h * 60 + 1, 60), F.lit(0.0), lambda a, x: a + x)

    keys = [c for c in wide.columns if c != minutes]
    if dict(wide.dtypes)[minutes].startswith("map"):
        hours = _hour_sums(F.map_entries(minutes))
    else:
        hours = F.transform(F.sequence(F.lit(0), F.lit(23)), hour_sum)
    return wide.select(*keys, F.posexplode(hours).alias("hour_of_day", "calls"))


def _hour_sums(entries: Column) -> Column:
    """24 sums over (minute, count) entries, in one pass."""

    def placed(entry: Column) -> Column:
        outside = F.raise_error(F.concat(F.lit("outside the day: minute "), entry["key"].cast("string"))).cast("int")
        hour = F.when(entry["key"].between(0, 1439), F.floor(entry["key"] / 60).cast("int")).otherwise(outside)
        return F.struct(hour.alias("hour"), entry["value"].alias("calls"))

    def add(sums: Column, entry: Column) -> Column:
        return F.transform(sums, lambda x, h: F.when(h == entry["hour"], x + entry["calls"]).otherwise(x))

    return F.aggregate(F.transform(entries, placed), F.array_repeat(F.lit(0.0), 24), add)


def consolidate_durations(durations: DataFrame) -> DataFrame:
    """Weighted mean duration per function and day, without invalid averages."""
    average = number(F.col("Average"))
    valid = durations.withColumn("Average", average).where(average.isNotNull() & (average >= 0))
    mean = (F.sum(F.col("Average") * F.col("Count")) / F.sum("Count")).alias("average_ms")
    return valid.groupBy(*FUNCTION_KEY).agg(mean)


def duplicate_metrics(frame: DataFrame, keys: tuple[str, ...], prefix: str) -> DataFrame:
    """One row: rows in duplicated key groups, and such groups without a null in the key."""
    groups = frame.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias(f"{prefix}_duplicate_row_count"),
        F.count_if(whole).cast("long").alias(f"{prefix}_duplicate_group_count"),
    )


def dense_grid(triggers: DataFrame, hours: int) -> DataFrame:
    """Every hour of every trigger; both sides are bounded by calendar and vocabulary."""
    at = triggers.select("Trigger", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("hour_index"))
    return at.select(
        (F.floor(F.col("hour_index") / 24) + 1).cast("int").alias("trace_day"),
        (F.col("hour_index") % 24).cast("int").alias("hour_of_day"),
        F.col("hour_index").cast("int").alias("hour_index"),
        "Trigger",
    )


def with_durations(invocations: DataFrame, durations: DataFrame) -> DataFrame:
    """Left join on day and function: unmatched invocations stay, without a duration."""
    return invocations.join(consolidate_durations(durations), list(FUNCTION_KEY), "left")


def hourly_demand(invocations: DataFrame, durations: DataFrame, triggers: DataFrame, hours: int) -> DataFrame:
    """Demand per hour and trigger on the dense grid, zero where nothing happened; what lies outside the grid raises.

    ``invocations`` has a row per function and hour with its ``calls``.
    ``active_functions`` counts those rows, whether or not they have a duration.
    """
    calls, matched = F.col("calls"), F.col("average_ms").isNotNull()
    observed = with_durations(invocations, durations).groupBy("hour_index", "Trigger").agg(
        F.sum(calls).alias("invocations"),
        F.sum(F.when(matched, calls * F.col("average_ms") / 1000.0)).alias("compute_seconds"),
        F.sum(F.when(matched, calls)).alias("matched"),
        F.count_if(calls > 0).alias("active_functions"),
    )
    return on_grid(observed, triggers, hours)


def on_grid(observed: DataFrame, triggers: DataFrame, hours: int) -> DataFrame:
    """Sums per hour and trigger laid on the dense grid; an hour or trigger outside it raises."""
    grid = dense_grid(triggers, hours).withColumn("known", F.lit(True))
    joined = grid.join(observed, ["hour_index", "Trigger"], "full")
    place = F.concat(F.lit("outside the grid: hour "), F.coalesce(F.col("hour_index").cast("string"), F.lit("null")), F.lit(", trigger "), F.coalesce("Trigger", F.lit("null")))
    filled = joined.withColumn("trace_day", F.when(F.col("known"), F.col("trace_day")).otherwise(F.raise_error(place).cast("int")))
    seconds = F.coalesce("compute_seconds", F.lit(0.0))
    return filled.select(
        "trace_day",
        "hour_of_day",
        "hour_index",
        "Trigger",
        F.coalesce("invocations", F.lit(0)).cast("long").alias("invocations"),
        seconds.alias("compute_seconds"),
        F.coalesce("active_functions", F.lit(0)).cast("long").alias("active_functions"),
        ratio(seconds * 1000.0, F.col("matched").cast("double")).alias("invocation_weighted_average_duration_ms"),
    )


def hourly_totals(demand: DataFrame, triggers: list[str]) -> DataFrame:
    """Totals across triggers, and each trigger's share of the invocations (null without any)."""
    total = F.sum("invocations")
    shares = [
        ratio(F.sum(F.when(F.col("Trigger") == t, F.col("invocations")).otherwise(0)).cast("double"), total.cast("double")).alias(
            f"invocation_share_{t}"
        )
        for t in triggers
    ]
    return demand.groupBy("trace_day", "hour_of_day", "hour_index").agg(
        total.cast("long").alias("total_invocations"),
        F.sum("compute_seconds").alias("total_compute_seconds"),
        F.sum("active_functions").cast("long").alias("total_active_functions"),
        *shares,
    )


def missing_durations(invocations: DataFrame, durations: DataFrame) -> DataFrame:
    """One row: function-days without a duration, their invocations, and both as percentages."""
    days = invocations.groupBy(*FUNCTION_KEY).agg(F.sum("calls").alias("calls"))
    miss = F.col("average_ms").isNull()
    return with_durations(days, durations).agg(
        F.count_if(miss).cast("long").alias("missing_functions"),
        F.try_divide(F.lit(100.0) * F.count_if(miss), F.count("*")).alias("missing_function_percentage"),
        F.coalesce(F.sum(F.when(miss, F.col("calls"))), F.lit(0)).cast("long").alias("missing_invocations"),
        F.try_divide(F.lit(100.0) * F.sum(F.when(miss, F.col("calls")).otherwise(0)), F.sum("calls")).alias("missing_invocation_percentage"),
    )


def memory_summary(memory: DataFrame) -> DataFrame:
    """Daily distribution of the applications' weighted mean memory."""
    weighted = F.sum(F.col("AverageAllocatedMb") * F.col("SampleCount")) / F.sum("SampleCount")
    apps = memory.groupBy("trace_day", "HashOwner", "HashApp").agg(weighted.alias("mb"))
    apps = materialize(apps, "applications")
    whole = apps.groupBy("trace_day").agg(F.count("*").cast("long").alias("application_count"), F.avg("mb").alias("mean_allocated_mb"))
    ranks = grouped_percentiles(apps, ["trace_day"], "mb", {"median_allocated_mb": 0.5, "p95_allocated_mb": 0.95})
    return whole.join(ranks, "trace_day", "left")


def reconciled(invocations: DataFrame, durations: DataFrame, demand: DataFrame, totals: DataFrame) -> DataFrame:
    """One row: the largest hourly differences between trigger rows and totals, those of the raw sums, and whether all are nil."""
    raw = with_durations(invocations, durations).agg(F.sum("calls").alias("_calls"), F.sum(F.col("calls") * F.col("average_ms") / 1000.0).alias("_seconds"))
    return reconciled_with(raw, demand, totals)


def reconciled_with(raw: DataFrame, demand: DataFrame, totals: DataFrame) -> DataFrame:
    """``reconciled`` with the raw sums given as one row (_calls, _seconds)."""
    by_hour = demand.groupBy("hour_index").agg(
        F.sum("invocations").alias("n"), F.sum("compute_seconds").alias("s"), F.sum("active_functions").alias("f")
    )
    pairs = by_hour.join(totals, "hour_index", "full")
    sides = {"invocation": ("n", "total_invocations"), "compute_seconds": ("s", "total_compute_seconds"), "active_function": ("f", "total_active_functions")}
    names = {k: f"max_hourly_{k}_difference" for k in sides}
    hourly = pairs.agg(
        *(F.max(F.abs(F.coalesce(F.col(a), F.lit(0)) - F.coalesce(F.col(b), F.lit(0)))).cast("double").alias(names[k]) for k, (a, b) in sides.items()),
        F.sum("total_invocations").alias("_n"), F.sum("total_compute_seconds").alias("_s"),
    )
    both = hourly.join(raw, F.lit(True))  # single rows
    calls, seconds = "raw_total_invocation_difference", "raw_total_compute_seconds_difference"
    both = both.withColumns({calls: F.abs(F.col("_n") - F.col("_calls")).cast("double"), seconds: F.abs(F.col("_s") - F.coalesce("_seconds", F.lit(0.0)))})
    exact = (F.col(names["invocation"]) == 0) & (F.col(names["active_function"]) == 0) & (F.col(calls) == 0)
    passed = exact & (F.col(names["compute_seconds"]) <= 1e-9) & (F.col(seconds) <= 1e-6)
    return both.select(passed.alias("reconciliation_passed"), *names.values(), calls, seconds)
