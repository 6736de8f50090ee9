"""The capacity chain obeys the stored selection; joins check themselves when they run."""

import json

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tidegauge.catalog import QUERIES
from tidegauge.operators import capacity, forecast, joins, sarimax
from tidegauge.plans import pipeline
from tidegauge.schema import GBDT, HOURLY_MEAN, SARIMAX, SEASONAL
from tidegauge.sources import sinks

METRIC = "split string, model string, aggregation_level string, Trigger string, MAE double, RMSE double, WAPE double"


def record(spark, tmp_path, winner, **changes):
    rows = [("validation", m, "total_demand", "ALL_TRIGGERS", 1.0, 1.0, 0.1 if m == winner else 0.5) for m in (SEASONAL, HOURLY_MEAN, SARIMAX, GBDT)]
    path = str(tmp_path / "selection")
    sinks.json_document(forecast.selection_record(spark.createDataFrame(rows, METRIC)), path)
    if changes:
        found = json.loads((tmp_path / "selection").read_text()) | changes
        path = str(tmp_path / "changed.json")
        (tmp_path / "changed.json").write_text(json.dumps({k: v for k, v in found.items() if v is not None}))
    return path


@pytest.mark.parametrize("winner", [SARIMAX, GBDT, SEASONAL])
def test_a_winner_without_a_forecast_is_refused(spark, tmp_path, winner):
    path = record(spark, tmp_path, winner)
    with pytest.raises(capacity.UnsupportedModel):
        capacity.selected_model(spark, path)
    assert capacity.selected_model(spark, path, pipeline.MODELS) == winner


@pytest.mark.parametrize("changes", [{"selection_criterion": "test WAPE"}, {"test_set_excluded_from_selection": False}, {"selected_model": None}])
def test_a_document_that_does_not_say_how_it_was_selected_is_refused(spark, tmp_path, changes):
    with pytest.raises(ValueError):
        capacity.selected_model(spark, record(spark, tmp_path, HOURLY_MEAN, **changes))


def test_every_model_forecasts_the_next_day(spark, data):
    base = pipeline.stored_demand(spark, data)
    series = {}
    for r in base.orderBy("hour_index").collect():
        series.setdefault(r["Trigger"], []).append(r["compute_seconds"])
    found = {}
    for model in (SEASONAL, HOURLY_MEAN, SARIMAX):
        rows = pipeline.model_points(spark, data, model).collect()
        assert len(rows) == 24 * 6 and {r["selected_model"] for r in rows} == {model}
        assert sorted({(r["forecast_horizon_hour"], r["hour_index"], r["hour_of_day"]) for r in rows}) == [(h, 719 + h, (719 + h) % 24) for h in range(1, 25)]
        found[model] = {(r["Trigger"], r["forecast_horizon_hour"]): r["point_forecast_compute_seconds"] for r in rows}
        for h in range(1, 25):
            assert found[model]["ALL_TRIGGERS", h] == pytest.approx(sum(found[model][t, h] for t in series))
    orders = {r["Trigger"]: (r["p"], r["q"], r["sq"]) for r in pipeline.sarimax_orders(spark, data).collect()}
    for t, ys in series.items():
        assert [found[SEASONAL][t, h] for h in range(1, 25)] == ys[-24:]
        assert [found[HOURLY_MEAN][t, h] for h in range(1, 25)] == pytest.approx([np.mean(ys[h - 1 :: 24]) for h in range(1, 25)])
        ahead = np.maximum(sarimax.forecast(np.array(ys[72:]), 24, *orders[t]), 0.0)
        assert [found[SARIMAX][t, h] for h in range(1, 25)] == pytest.approx(ahead.tolist())


def test_the_chain_simulates_the_selected_model(spark, data):
    chosen = QUERIES["model_selection_all_models"](spark, data).first()["selected_model"]
    points = QUERIES["future_point_forecast_all_models"](spark, data)
    assert {r[0] for r in points.select("selected_model").distinct().collect()} == {chosen} and points.count() == 144
    ahead, errors = pipeline.selected_inputs(spark, data)
    one = {r["vector"]: r["residuals"] for r in errors.collect()}
    want = {r["vector"]: r["residuals"] for r in capacity.residual_vectors(pipeline.all_predictions(spark, data), chosen).collect()}
    assert one == want and len(one) == 120
    rows = QUERIES["capacity_recommendation_all_models"](spark, data).collect()
    again = capacity.recommendation(capacity.scenarios(ahead, capacity.simulate(ahead, errors)))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, pipeline.rounded(again).collect())) and len(rows) == 10
    # the trees forecast the next day, too, from features of observed hours
    trees = pipeline.model_points(spark, data, GBDT).where("aggregation_level = 'trigger'").collect()
    assert len(trees) == 120 and all(r["point_forecast_compute_seconds"] >= 0 for r in trees)


def two(spark, left, right):
    return spark.createDataFrame(left, "k int, x string"), spark.createDataFrame(right, "k int, y string, z int")


@pytest.mark.parametrize(
    ("left", "right"),
    [([(1, "a"), (1, "b")], [(1, "c", 1)]), ([(1, "a")], [(1, "c", 1), (1, "d", 2)]), ([(1, "a"), (2, "b")], [(1, "c", 1)]), ([(1, "a")], [(1, "c", 1), (None, "d", 2)])],
)
def test_matched_raises_only_when_it_runs(spark, left, right):
    plan = joins.matched(*two(spark, left, right), ["k"], "pairs")
    with pytest.raises(PySparkException, match="pairs: not one to one"):
        plan.collect()


def test_matched_joins(spark):
    found = joins.matched(*two(spark, [(1, None), (2, "b")], [(2, "c", 1), (1, "d", None)]), ["k"])
    assert found.columns == ["k", "x", "y", "z"] and sorted(found.collect()) == [(1, None, "d", None), (2, "b", "c", 1)]


def test_a_missing_mean_raises(spark):
    rows = [(h, h % 24, "a", float(h), "train" if h < 24 else "test") for h in range(30)]
    schema = "hour_index int, hour_of_day int, Trigger string, compute_seconds double, split string"
    assert forecast.hour_of_day_mean(spark.createDataFrame(rows, schema), "test", HOURLY_MEAN).count() == 6
    with pytest.raises(PySparkException, match="no mean for"):
        forecast.hour_of_day_mean(spark.createDataFrame(rows[3:], schema), "test", HOURLY_MEAN).collect()
