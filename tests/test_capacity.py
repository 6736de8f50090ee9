import pytest

from tidegauge.operators import capacity, reports

POINT = "forecast_horizon_hour int, hour_index int, hour_of_day int, aggregation_level string, Trigger string, point_forecast_compute_seconds double"


def points(spark):
    rows = [(h, h, h % 24, "trigger", t, 5.0) for h in range(1, 25) for t in "ab"]
    rows += [(h, h, h % 24, "total_demand", "ALL_TRIGGERS", 10.0) for h in range(1, 25)]
    return spark.createDataFrame(rows, POINT)


def vectors(spark, *residuals):
    return spark.createDataFrame([(k, k, k, list(v)) for k, v in enumerate(residuals)], "vector int, hour_index int, hour_of_day int, residuals array<double>")


def test_triggers_are_clipped_before_they_are_summed(spark):
    found = capacity.simulate(points(spark), vectors(spark, (-9.0, 1.0)), simulations=3)
    assert {r["total"] for r in found.collect()} == {6.0} and found.count() == 72


def test_demand_equal_to_capacity_is_no_shortage(spark):
    found = capacity.scenarios(points(spark), capacity.simulate(points(spark), vectors(spark, (0.0, 0.0)), simulations=4), (0, 10))
    rows = {r["headroom_percent"]: r for r in found.where("forecast_horizon_hour = 1").collect()}
    assert rows[0]["shortage_probability"] == 0.0 and rows[10]["expected_unused_capacity"] == pytest.approx(1.0)


def test_no_passing_headroom_gives_no_recommendation(spark):
    found = capacity.scenarios(points(spark), capacity.simulate(points(spark), vectors(spark, (50.0, 50.0)), simulations=4), (0, 10))
    rows = capacity.recommendation(found)
    assert rows.where("is_minimum_recommended_headroom or minimum_recommended_headroom_percent is not null").count() == 0
    numbers = ["headroom_percent", "minimum_recommended_headroom_percent"]
    with pytest.raises(reports.InvalidTable):
        reports.validated("recommendation", rows, ["headroom_percent"], numbers)


def test_other_models_are_refused():
    capacity.require_supported("Historical Hour-of-Day Mean")
    with pytest.raises(capacity.UnsupportedModel):
        capacity.require_supported("SARIMAX")


def test_draws_are_repeatable_and_in_range(spark):
    a, b = (capacity.draws(spark, 7, 50).orderBy("forecast_horizon_hour", "simulation").collect() for _ in range(2))
    assert a == b and {r["vector"] for r in a} == set(range(7)) and len(a) == 24 * 50


def test_percentile_of_the_total_is_of_the_sums(spark):
    drawn = capacity.simulate(points(spark), vectors(spark, (4.0, -4.0), (-4.0, 4.0)), simulations=50)
    rows = capacity.intervals(points(spark), drawn, ["a", "b"]).where("forecast_horizon_hour = 1")
    found = {r["Trigger"]: r["simulated_P99_compute_seconds"] for r in rows.collect()}
    assert found["ALL_TRIGGERS"] == 10.0 and found["a"] == 9.0


def test_joins_must_be_one_to_one(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, y string")
    with pytest.raises(reports.InvalidTable):
        reports.one_to_one(left, right, ["k"])


def test_measures(spark):
    versus = spark.createDataFrame([(1.0, "m"), (2.0, "m")], "actual_compute_seconds double, selected_model string")
    assert tuple(versus.agg(reports.total_actual_demand(), reports.selected_model()).first()) == (3.0, "m")
    two = versus.unionAll(spark.createDataFrame([(1.0, "n")], versus.schema))
    assert two.agg(reports.selected_model()).first()[0] is None
