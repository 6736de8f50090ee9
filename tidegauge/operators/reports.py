"""Business tables, measures and report queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import close, finite
from tidegauge.operators.joins import matched
from tidegauge.schema import TOTAL
from tidegauge.sources.contracts import wrong_types


class InvalidTable(ValueError):
    """A business table breaks its contract."""


def violations(frame: DataFrame, keys: list[str], numerics: list[str]) -> DataFrame:
    """One row of counts, all 0 for a valid table: rows missing, nulls, numbers not finite, repeated keys."""
    nulls = reduce(lambda a, b: a + b, (F.count_if(F.col(c).isNull()) for c in frame.columns))
    odd = reduce(lambda a, b: a + b, (F.count_if(F.col(c).isNotNull() & ~finite(F.col(c).cast("double"))) for c in numerics), F.lit(0))
    repeated = frame.groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).cast("long").alias("repeated_keys"))
    return frame.agg(
        F.when(F.count("*") == 0, 1).otherwise(0).cast("long").alias("empty"),
        nulls.cast("long").alias("nulls"),
        odd.cast("long").alias("not_finite"),
    ).join(repeated, F.lit(True))  # single rows


def validated(name: str, frame: DataFrame, keys: list[str], numerics: list[str]) -> DataFrame:
    """The table itself, or InvalidTable: column types are checked first, which takes no job."""
    odd = wrong_types(frame)
    if odd:
        raise InvalidTable(f"{name}: types of {', '.join(odd)}")
    row = violations(frame, keys, numerics).first().asDict()
    if any(row.values()):
        raise InvalidTable(f"{name}: {row}")
    return frame


def demand_history(demand: DataFrame) -> DataFrame:
    return demand.select("hour_index", "trace_day", "hour_of_day", F.col("Trigger").alias("trigger"), "invocations", "compute_seconds")


def model_performance(evaluated: DataFrame) -> DataFrame:
    trigger = F.when(F.col("Trigger") == TOTAL, "TOTAL").otherwise(F.col("Trigger"))
    return evaluated.select("model", F.col("split").alias("dataset_split"), trigger.alias("trigger"), "MAE", "RMSE", "WAPE")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two frames that hold each key once and the same keys; anything else raises when it runs."""
    def counted(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy(*keys).agg(F.count("*").alias(name))

    both = counted(left, "l").join(counted(right, "r"), keys, "full")
    wrong = both.where(~F.coalesce((F.col("l") == 1) & (F.col("r") == 1), F.lit(False))).limit(1).count()
    if wrong:
        raise InvalidTable(f"not one to one on {keys}")
    return left.join(right, keys)


def forecast_vs_actual(predictions: DataFrame, selected: str, columns: dict[str, str]) -> DataFrame:
    """Test predictions of several models side by side; other keys or actual values raise when the rows are made."""
    keys = ["hour_index", "Trigger"]

    def of(model: str, name: str) -> DataFrame:
        rows = predictions.where((F.col("split") == "test") & (F.col("model") == model))
        return rows.select(*keys, F.col("actual_compute_seconds").alias(f"actual_{name}"), F.col("predicted_compute_seconds").alias(name))

    out = of(selected, "selected_forecast").withColumnRenamed("actual_selected_forecast", "actual_compute_seconds")
    for name, model in columns.items():
        out = matched(out, of(model, name), keys, model)
        other = ~close(F.col("actual_compute_seconds"), F.col(f"actual_{name}"))
        checked = F.when(other, F.raise_error(F.lit(f"{model}: other actual values"))).otherwise(F.col(name))
        out = out.withColumn(name, checked).drop(f"actual_{name}")
    return out.select(
        "hour_index", F.col("Trigger").alias("trigger"), "actual_compute_seconds", *columns, F.lit(selected).alias("selected_model"), "selected_forecast"
    )


def future_forecast(intervals: DataFrame) -> DataFrame:
    trigger = F.when(F.col("Trigger") == TOTAL, "TOTAL").otherwise(F.col("Trigger")).alias("trigger")
    names = [F.col(f"simulated_P{p}_compute_seconds").alias(f"P{p}") for p in (50, 80, 90, 95, 99)]
    return intervals.select(
        F.col("forecast_horizon_hour").alias("forecast_hour"), trigger, F.col("point_forecast_compute_seconds").alias("point_forecast"), *names
    )


def capacity_scenarios(scenarios: DataFrame) -> DataFrame:
    return scenarios.select(
        F.col("forecast_horizon_hour").alias("forecast_hour"), F.col("headroom_percent").alias("headroom_pct"),
        F.col("point_forecast_compute_seconds").alias("point_forecast"), F.col("required_capacity_compute_seconds").alias("capacity"),
        "shortage_probability", "expected_shortage_compute_seconds", "expected_unused_capacity",
    )


# Measures: aggregates that a report evaluates over whatever rows its filters leave.


def total_actual_demand() -> Column:
    return F.sum("actual_compute_seconds")


def selected_model() -> Column:
    """The model's name where exactly one is in view, else null."""
    return F.when(F.countDistinct("selected_model") == 1, F.max("selected_model"))


def test_wape(performance: DataFrame, model: str | None) -> DataFrame:
    """WAPE of the model's test totals, whatever filters stand on the performance table."""
    rows = performance.where((F.col("dataset_split") == "test") & (F.col("trigger") == "TOTAL") & (F.col("model") == F.lit(model)))
    return rows.agg(F.max("WAPE").alias("test_wape"))


def recommended_headroom() -> Column:
    """The recommended headroom as a fraction, null without one."""
    return F.max(F.when(F.col("is_minimum_recommended_headroom"), F.col("minimum_recommended_headroom_percent"))) / 100


def recommended_capacity(percent: Column) -> Column:
    return F.max(F.when(F.col("headroom_pct") == percent, F.col("capacity")))


def kpis(versus: DataFrame, performance: DataFrame, recommended: DataFrame) -> DataFrame:
    """The four cards of the report in one row."""
    head = versus.agg(total_actual_demand().alias("total_actual_demand"), selected_model().alias("selected_model"))
    wape = performance.where("dataset_split = 'test' and trigger = 'TOTAL'").select(F.col("model").alias("selected_model"), "WAPE")
    room = recommended.agg(recommended_headroom().alias("recommended_capacity_headroom"))
    return head.join(wape, "selected_model", "left").withColumnRenamed("WAPE", "test_wape").join(room, F.lit(True))  # one row each


def recommended_by_hour(scenarios: DataFrame, recommended: DataFrame) -> DataFrame:
    """Point forecast and recommended capacity by forecast hour."""
    percent = recommended.agg((recommended_headroom() * 100).alias("percent"))
    rows = scenarios.join(F.broadcast(percent), F.lit(True))  # one row
    return rows.groupBy("forecast_hour").agg(
        F.max("point_forecast").alias("point_forecast"), recommended_capacity(F.round("percent", 6)).alias("recommended_capacity")
    )


def trigger_slice(versus: DataFrame, trigger: str | None = None) -> DataFrame:
    """The report's trigger filter: everything where none is chosen."""
    return versus if trigger is None else versus.where(F.col("trigger") == trigger)


def actual_vs_selected(versus: DataFrame, trigger: str | None = None) -> DataFrame:
    return trigger_slice(versus, trigger).groupBy("hour_index").agg(
        F.sum("actual_compute_seconds").alias("actual"), F.sum("selected_forecast").alias("selected")
    )


def actual_by_trigger(versus: DataFrame) -> DataFrame:
    return versus.groupBy("trigger").agg(total_actual_demand().alias("actual"))


def test_metric_by_model(performance: DataFrame, metric: str) -> DataFrame:
    rows = performance.where("dataset_split = 'test' and trigger = 'TOTAL'")
    return rows.groupBy("model").agg(F.max(metric).alias(metric))


def forecasts_by_hour(versus: DataFrame, columns: list[str]) -> DataFrame:
    return versus.groupBy("hour_index").agg(*(F.sum(c).alias(c) for c in ["actual_compute_seconds", *columns, "selected_forecast"]))


def uncertainty_by_hour(future: DataFrame) -> DataFrame:
    rows = future.where("trigger = 'TOTAL'")
    return rows.groupBy("forecast_hour").agg(*(F.max(c).alias(c) for c in ("point_forecast", "P50", "P90", "P95")))


def by_headroom(recommended: DataFrame, column: str) -> DataFrame:
    return recommended.groupBy("headroom_percent").agg(F.max(column).alias(column))


def importance_by_feature(gains: DataFrame) -> DataFrame:
    """Gain share of every feature, largest first."""
    return gains.groupBy("feature").agg(F.max("gain_percentage").alias("gain_percentage")).orderBy(F.desc("gain_percentage"), "feature")


#: Keys and numbers of the published tables; every column must hold a value.
TABLES = {
    "demand_history": (["hour_index", "trigger"], ["invocations", "compute_seconds"]),
    "model_performance": (["model", "dataset_split", "trigger"], ["MAE", "RMSE", "WAPE"]),
    "forecast_vs_actual": (["hour_index", "trigger"], ["actual_compute_seconds", "baseline_forecast", "selected_forecast"]),
    "future_forecast": (["forecast_hour", "trigger"], ["point_forecast", "P50", "P80", "P90", "P95", "P99"]),
    "capacity_scenarios": (
        ["forecast_hour", "headroom_pct"],
        ["point_forecast", "capacity", "shortage_probability", "expected_shortage_compute_seconds", "expected_unused_capacity"],
    ),
    "capacity_recommendation": (
        ["headroom_percent"],
        ["maximum_hourly_shortage_probability", "average_shortage_probability", "expected_total_shortage", "average_unused_capacity"],
    ),
}


def table_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, empty, nulls, not_finite, repeated_keys) of the published tables."""
    rows = [violations(tables[name], *contract).withColumn("table_name", F.lit(name)) for name, contract in TABLES.items()]
    return reduce(DataFrame.unionByName, rows)
