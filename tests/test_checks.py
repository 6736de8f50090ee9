import pytest
from pyspark.sql import functions as F

from tidegauge.operators import checks


def bad(report):
    return {r["rule"] for r in report.where("violations > 0").collect()}


def demand(spark, hours=240):
    rows = [(h // 24 + 1, h % 24, h, t, 1.0) for h in range(hours) for t in "ab"]
    return spark.createDataFrame(rows, "trace_day int, hour_of_day int, hour_index int, Trigger string, compute_seconds double")


def test_good_panel_passes(spark):
    checks.require(checks.panel_rules(demand(spark), 240))


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        (lambda d: d.where("not (hour_index = 100 and Trigger = 'a')"), "panel_continuous"),
        (lambda d: d.unionAll(d.limit(1)), "panel_unique"),
        (lambda d: d.withColumn("compute_seconds", F.when(F.col("hour_index") == 3, -1.0).otherwise(1.0)), "panel_target"),
        (lambda d: d.withColumn("compute_seconds", F.when(F.col("hour_index") == 3, F.lit(float("nan"))).otherwise(1.0)), "panel_target"),
        (lambda d: d.withColumn("hour_of_day", F.lit(1)), "panel_hour_of_day"),
        (lambda d: d.where("hour_index < 100"), "panel_long_enough"),
        (lambda d: d.withColumn("Trigger", F.when(F.col("hour_index") > 5, F.col("Trigger"))), "panel_keys_present"),
    ],
)
def test_broken_panels_are_found(spark, change, rule):
    report = checks.panel_rules(change(demand(spark)), 240)
    assert rule in bad(report)
    with pytest.raises(checks.Violation):
        checks.require(report)


def test_input_rules(spark):
    durations = spark.createDataFrame([(1,), (0,), (None,)], "Count int")
    assert checks.duration_rules(durations).first()["violations"] == 2
    memory = spark.createDataFrame([(-1.0, 1), (1.0, 0)], "AverageAllocatedMb double, SampleCount int")
    assert bad(checks.memory_rules(memory)) == {"memory_finite", "memory_samples_positive"}
    calls = spark.createDataFrame([(1.5, "a"), (-1.0, "b")], "calls double, Trigger string")
    assert bad(checks.invocation_rules(calls, ("a",))) == {"calls_finite", "calls_integral", "trigger_known"}


def test_day_sets(spark):
    found = checks.day_difference(spark.createDataFrame([(1,), (4,)], "trace_day int"), range(1, 4)).collect()
    assert {(r["day"], r["state"]) for r in found} == {(2, "missing"), (3, "missing"), (4, "unexpected")}


def test_predictions_share_rows_and_actuals(spark):
    rows = [("test", "m", 1, "a", 1.0, 2.0), ("test", "n", 1, "a", 5.0, -2.0), ("test", "m", 2, "a", 1.0, None)]
    schema = "split string, model string, hour_index int, Trigger string, actual_compute_seconds double, predicted_compute_seconds double"
    assert bad(checks.prediction_rules(spark.createDataFrame(rows, schema))) == {
        "prediction_finite", "prediction_non_negative", "models_share_rows", "models_share_actuals",
    }


def inputs(spark, change=lambda h, row: row):
    from tidegauge.schema import FEATURES

    rows = [change(h, {**dict.fromkeys(FEATURES, 1.0), "hour_index": h, "Trigger": "a", "compute_seconds": float(h), "lag_1": h - 1.0}) for h in range(5)]
    columns = ["hour_index", "Trigger", "compute_seconds", *FEATURES]
    schema = ", ".join(f"`{c}` {'int' if c == 'hour_index' else 'string' if c == 'Trigger' else 'double'}" for c in columns)
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows if r], schema)


@pytest.mark.parametrize(
    ("change", "rules"),
    [
        (lambda h, r: r, set()),
        (lambda h, r: {**r, "lag_24": None} if h == 2 else r, {"features_finite"}),
        (lambda h, r: {**r, "lag_24": float("inf")} if h == 2 else r, {"features_finite"}),
        (lambda h, r: {**r, "lag_1": 9.0} if h == 2 else r, {"lag_1_is_the_hour_before"}),
        (lambda h, r: None if h == 2 else r, {"feature_hours_continuous", "lag_1_is_the_hour_before"}),
    ],
)
def test_model_inputs(spark, change, rules):
    assert bad(checks.model_input_rules(inputs(spark, change))) == rules


def test_history_bounds(spark):
    assert bad(checks.history_rules(demand(spark), 240, 2)) == set()
    assert bad(checks.history_rules(demand(spark).where("hour_index > 0"), 240, 2)) == {"history_starts_at_zero", "history_rows"}


def test_metric_and_selection_rules(spark):
    rows = [(s, m, t) for s in ("validation", "test") for m in ("x", "y") for t in ("a", "ALL_TRIGGERS")]
    frame = spark.createDataFrame(rows, "split string, model string, Trigger string")
    assert bad(checks.metric_rules(frame, 2, 1)) == set()
    assert bad(checks.metric_rules(frame.where("not (model = 'x' and Trigger != 'a')"), 2, 1)) == {"metric_rows", "one_total_per_model"}
    schema = "selected_model string, validation_WAPE double, selection_criterion string, test_set_excluded_from_selection boolean"
    good = ("x", 0.1, "lowest aggregated validation WAPE", True)
    assert bad(checks.selection_rules(spark.createDataFrame([good], schema))) == set()
    wrong = spark.createDataFrame([("x", None, "lowest test WAPE", False)], schema)
    assert bad(checks.selection_rules(wrong)) == {"selection_complete", "selection_criterion", "selection_without_test"}
    assert bad(checks.selection_rules(spark.createDataFrame([], schema))) == {"one_selection"}


def test_future_rules(spark):
    intervals = spark.createDataFrame([(h, t) for h in (1, 2) for t in ("a", "ALL_TRIGGERS")], "forecast_horizon_hour int, Trigger string")
    schema = (
        "forecast_horizon_hour int, headroom_percent int, required_capacity_compute_seconds double, expected_shortage_compute_seconds double, "
        "expected_unused_capacity double"
    )
    scenarios = spark.createDataFrame([(h, p, 1.0, 0.0, 1.0) for h in (1, 2) for p in (0, 5)], schema)
    assert bad(checks.future_rules(intervals, scenarios, 2, 1, 2)) == set()
    broken = scenarios.limit(3).unionAll(spark.createDataFrame([(2, 5, 1.0, -1.0, 1.0)], schema)).limit(4)
    assert bad(checks.future_rules(intervals.unionAll(intervals.limit(1)), broken, 2, 1, 2)) >= {"forecast_rows", "amounts_non_negative"}
