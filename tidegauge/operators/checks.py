"""Constraints of the pipeline as counts of violations, and guards that raise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import close, finite
from tidegauge.schema import FEATURES, LAGS, TOTAL


class Violation(ValueError):
    """A constraint does not hold."""


def require(report: DataFrame) -> None:
    """Raise if any row of a (rule, violations) report counts one."""
    bad = report.where("violations > 0").limit(20).collect()
    if bad:
        raise Violation(", ".join(f"{r['rule']}: {r['violations']}" for r in bad))


def counted(frame: DataFrame, rules: dict) -> DataFrame:
    """(rule, violations) from one aggregation of conditions that should never hold."""
    row = frame.agg(*(F.count_if(F.coalesce(c, F.lit(True))).cast("long").alias(k) for k, c in rules.items()))
    return row.unpivot([], list(rules), "rule", "violations")


def day_difference(found: DataFrame, expected: range, col: str = "trace_day") -> DataFrame:
    """(day, state): expected days that are missing and found days that are not expected."""
    want = found.sparkSession.range(expected.start, expected.stop).select(F.col("id").cast("int").alias("day"))
    have = found.select(F.col(col).cast("int").alias("day"))
    missing = want.subtract(have).withColumn("state", F.lit("missing"))
    return missing.unionByName(have.subtract(want).withColumn("state", F.lit("unexpected")))


def duration_rules(durations: DataFrame) -> DataFrame:
    count = F.col("Count").cast("double")
    return counted(durations, {"duration_count_positive": ~(finite(count) & (count > 0))})


def memory_rules(memory: DataFrame) -> DataFrame:
    mb, n = F.col("AverageAllocatedMb").cast("double"), F.col("SampleCount").cast("double")
    return counted(memory, {"memory_finite": ~finite(mb) | (mb < 0), "memory_samples_positive": ~finite(n) | (n <= 0)})


def invocation_rules(invocations: DataFrame, vocabulary: tuple[str, ...]) -> DataFrame:
    calls = F.col("calls").cast("double")
    return counted(
        invocations,
        {
            "calls_finite": ~finite(calls) | (calls < 0),
            "calls_integral": calls != F.floor(calls),
            "trigger_known": ~F.col("Trigger").isin(*vocabulary),
        },
    )


def panel_rules(demand: DataFrame, hours: int, least_hours: int = 192) -> DataFrame:
    """Grid, continuity and target of the hourly panel."""
    y = F.col("compute_seconds")
    rows = counted(
        demand,
        {
            "panel_keys_present": F.col("hour_index").isNull() | F.col("Trigger").isNull(),
            "panel_target": ~finite(y) | (y < 0),
            "panel_hour_of_day": F.col("hour_of_day") != F.col("hour_index") % 24,
        },
    )
    grid = demand.groupBy("Trigger").agg(
        F.count("*").alias("n"), F.countDistinct("hour_index").alias("d"), F.min("hour_index").alias("lo"), F.max("hour_index").alias("hi")
    )
    gaps = counted(
        grid,
        {
            "panel_unique": F.col("n") != F.col("d"),
            "panel_continuous": F.col("hi") - F.col("lo") + 1 != F.col("d"),
            "panel_full_grid": F.col("d") != hours,
            "panel_long_enough": F.col("d") <= least_hours,
        },
    )
    days = demand.groupBy("trace_day").agg(F.countDistinct("hour_index").alias("d"))
    return rows.unionByName(gaps).unionByName(counted(days, {"day_has_24_hours": F.col("d") != 24}))


def reconciliation(demand: DataFrame, totals: DataFrame, invocations: DataFrame) -> DataFrame:
    """Raw calls = trigger rows = hourly totals, exactly; compute seconds within tolerance."""
    a = invocations.agg(F.sum("calls").alias("raw"))
    b = demand.agg(F.sum("invocations").alias("by_trigger"), F.sum("compute_seconds").alias("s1"))
    c = totals.agg(F.sum("total_invocations").alias("by_hour"), F.sum("total_compute_seconds").alias("s2"))
    one = a.join(b, F.lit(True)).join(c, F.lit(True))  # single rows
    return counted(
        one,
        {
            "raw_equals_trigger": F.col("raw") != F.col("by_trigger"),
            "trigger_equals_total": F.col("by_trigger") != F.col("by_hour"),
            "seconds_reconcile": ~close(F.col("s1"), F.col("s2"), 1e-9, 1e-6),
        },
    )


def feature_rules(features: DataFrame) -> DataFrame:
    lagged = [F.col(f"lag_{k}").isNull() for k in LAGS]
    share, load = F.col("lag24_trigger_share"), F.col("historical_load_ratio")
    missing = lagged[0]
    for c in lagged[1:]:
        missing = missing | c
    return counted(
        features,
        {
            "lags_present": missing,
            "share_in_range": share.isNotNull() & ~share.between(0, 1),
            "load_ratio_finite": load.isNotNull() & (~finite(load) | (load < 0)),
        },
    )


def split_rules(features: DataFrame, validation_hours: int, test_hours: int) -> DataFrame:
    """Order and length of the splits, equal for every trigger."""
    by = features.groupBy("Trigger").agg(
        *(F.min(F.when(F.col("split") == s, F.col("hour_index"))).alias(f"{s}_lo") for s in ("train", "validation", "test")),
        *(F.max(F.when(F.col("split") == s, F.col("hour_index"))).alias(f"{s}_hi") for s in ("train", "validation", "test")),
    )
    return counted(
        by,
        {
            "train_before_validation": F.col("train_hi") >= F.col("validation_lo"),
            "validation_before_test": F.col("validation_hi") >= F.col("test_lo"),
            "validation_length": F.col("validation_hi") - F.col("validation_lo") + 1 != validation_hours,
            "test_length": F.col("test_hi") - F.col("test_lo") + 1 != test_hours,
        },
    )


def prediction_rules(predictions: DataFrame) -> DataFrame:
    p = F.col("predicted_compute_seconds")
    one = counted(predictions, {"prediction_finite": ~finite(p), "prediction_non_negative": p < 0})
    spread = predictions.groupBy("split", "hour_index", "Trigger").agg(
        F.countDistinct("model").alias("models"), F.count("*").alias("n"), (F.max("actual_compute_seconds") - F.min("actual_compute_seconds")).alias("gap")
    )
    total = predictions.select("model").distinct().count()
    return one.unionByName(
        counted(spread, {"models_share_rows": (F.col("models") != total) | (F.col("n") != total), "models_share_actuals": F.abs("gap") > 1e-6})
    )


def capacity_rules(points: DataFrame, intervals: DataFrame, scenarios: DataFrame, recommended: DataFrame) -> DataFrame:
    p = [F.col(f"simulated_P{k}_compute_seconds") for k in (50, 80, 90, 95, 99)]
    disorder = p[0] > p[1] + 1e-9
    for a, b in zip(p[1:], p[2:]):
        disorder = disorder | (a > b + 1e-9)
    chance, capacity = F.col("shortage_probability"), F.col("required_capacity_compute_seconds")
    arithmetic = F.col("point_forecast_compute_seconds") * (1 + F.col("headroom_percent") / 100.0)
    flags = recommended.agg(F.count_if("is_minimum_recommended_headroom").alias("n"))
    parts = [
        counted(points, {"points_non_negative": F.col("point_forecast_compute_seconds") < 0}),
        counted(intervals, {"percentiles_ordered": disorder}),
        counted(scenarios, {"probability_in_range": ~chance.between(0, 1), "capacity_arithmetic": ~close(capacity, arithmetic)}),
        counted(flags, {"one_recommendation": F.col("n") > 1}),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def history_rules(demand: DataFrame, hours: int, triggers: int) -> DataFrame:
    """The observed history starts at hour 0 and has a row per hour and trigger."""
    bounds = demand.agg(F.min("hour_index").alias("lo"), F.count("*").alias("n"))
    return counted(bounds, {"history_starts_at_zero": F.col("lo") != 0, "history_rows": F.col("n") != hours * triggers})


def model_input_rules(features: DataFrame) -> DataFrame:
    """What a model may read: finite features, steps of one hour, and a first lag that is the observation before it."""
    by = Window.partitionBy("Trigger").orderBy("hour_index")
    rows = features.select(
        reduce(lambda a, b: a & b, (finite(F.col(c).cast("double")) for c in FEATURES)).alias("finite"), "lag_1", "hour_index",
        F.lag("hour_index").over(by).alias("hour_before"), F.lag("compute_seconds").over(by).alias("seconds_before"),
    )
    later = F.col("hour_before").isNotNull()
    return counted(
        rows,
        {
            "features_finite": ~F.col("finite"),
            "feature_hours_continuous": later & (F.col("hour_index") - F.col("hour_before") != 1),
            "lag_1_is_the_hour_before": later & ~F.coalesce(F.abs(F.col("lag_1") - F.col("seconds_before")) <= 1e-9, F.lit(False)),
        },
    )


def metric_rules(evaluated: DataFrame, models: int, triggers: int) -> DataFrame:
    """A metric row per model and trigger and one total row per model, in each split."""
    by = evaluated.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("model").alias("models"))
    totals = evaluated.groupBy("split", "model").agg(F.count_if(F.col("Trigger") == TOTAL).alias("totals"))
    rows = counted(by, {"metric_rows": F.col("n") != models * (triggers + 1), "metric_models": F.col("models") != models})
    return rows.unionByName(counted(totals, {"one_total_per_model": F.col("totals") != 1}))


def future_rules(intervals: DataFrame, scenarios: DataFrame, horizon: int, triggers: int, headrooms: int) -> DataFrame:
    """Row counts of the forecast and of its scenarios, and amounts that are not negative."""
    rows = intervals.agg(F.count("*").alias("n"), F.countDistinct("forecast_horizon_hour", "Trigger").alias("d"))
    tested = scenarios.agg(F.count("*").alias("n"), F.countDistinct("forecast_horizon_hour", "headroom_percent").alias("d"))
    want, most = horizon * (triggers + 1), horizon * headrooms
    amounts = ("required_capacity_compute_seconds", "expected_shortage_compute_seconds", "expected_unused_capacity")
    parts = [
        counted(rows, {"forecast_rows": (F.col("n") != want) | (F.col("d") != want)}),
        counted(tested, {"scenario_rows": (F.col("n") != most) | (F.col("d") != most)}),
        counted(scenarios, {"amounts_non_negative": reduce(lambda a, b: a | b, (F.col(c) < 0 for c in amounts))}),
    ]
    return reduce(DataFrame.unionByName, parts)


def selection_rules(record: DataFrame) -> DataFrame:
    """One record with all its fields, the declared criterion, and no use of the test set."""
    text, excluded = F.col("selection_criterion"), F.col("test_set_excluded_from_selection")
    missing = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in record.columns))
    one = counted(record.agg(F.count("*").alias("n")), {"one_selection": F.col("n") != 1})
    rules = {"selection_complete": missing, "selection_criterion": text != "lowest aggregated validation WAPE", "selection_without_test": ~excluded}
    return one.unionByName(counted(record, rules))
