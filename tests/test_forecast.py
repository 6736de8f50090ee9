import numpy as np
import pytest

from tidegauge.operators import forecast, gbdt, sarimax

PANEL = "hour_index int, hour_of_day int, Trigger string, compute_seconds double, split string"


def panel(spark, hours=168, start=96, split="validation"):
    rows = [(h, h % 24, "a", float(h), split if h >= start else "train") for h in range(hours)]
    return spark.createDataFrame(rows, PANEL)


def test_fixed_origin_repeats_the_last_day_before_the_split(spark):
    found = {r["hour_index"]: r["predicted_compute_seconds"] for r in forecast.seasonal_fixed_origin(panel(spark), "validation", "m").collect()}
    want, known = {}, {h: float(h) for h in range(96)}
    for h in range(96, 168):  # the recursion that the closed form replaces
        want[h] = known[h] = known[h - 24]
    assert found == want


def test_walk_forward_reads_the_day_before(spark):
    found = {r["hour_index"]: r["predicted_compute_seconds"] for r in forecast.seasonal_walk_forward(panel(spark), "validation", "m").collect()}
    assert found == {h: float(h - 24) for h in range(96, 168)}


RESULT = "split string, model string, hour_index int, hour_of_day int, Trigger string, actual_compute_seconds double, predicted_compute_seconds double"


def test_total_metrics_sum_by_hour_first(spark):
    rows = [("test", "m", 0, 0, "a", 10.0, 12.0), ("test", "m", 0, 0, "b", 10.0, 8.0)]
    found = {r["Trigger"]: r for r in forecast.evaluate(spark.createDataFrame(rows, RESULT)).collect()}
    assert found["a"]["WAPE"] == 0.2 and found["ALL_TRIGGERS"]["MAE"] == 0.0


def test_wape_is_null_without_actual_demand(spark):
    row = forecast.evaluate(spark.createDataFrame([("test", "m", 0, 0, "a", 0.0, 1.0)], RESULT)).first()
    assert row["WAPE"] is None and row["MAE"] == 1.0


def test_ties_share_a_rank_and_are_selected_by_name(spark):
    rows = [(s, m, h, h, "a", 10.0, p) for s in ("validation", "test") for m, p in (("x", 11.0), ("b", 9.0), ("c", 15.0)) for h in range(2)]
    metrics = forecast.evaluate(spark.createDataFrame(rows, RESULT))
    ranks = {r["model"]: (r["validation_wape_rank"], r["selected_on_validation"]) for r in forecast.rank_models(metrics).where("split='test'").collect()}
    assert ranks == {"b": (1, True), "x": (1, False), "c": (3, False)}


def test_published_metrics_are_confirmed(spark):
    metrics = forecast.evaluate(spark.createDataFrame([("test", "m", 0, 0, "a", 0.0, 1.0), ("test", "m", 1, 1, "b", 2.0, 1.0)], RESULT))
    assert forecast.reconcile(metrics, metrics).count() == 0
    changed = metrics.withColumn("MAE", metrics["MAE"] + 0.1).where("Trigger != 'b'")
    assert forecast.reconcile(changed, metrics).count() == 3


def test_selection_never_reads_the_test_split(spark):
    rows = [("validation", "v", 0, 0, "a", 10.0, 10.0), ("validation", "t", 0, 0, "a", 10.0, 11.0)]
    rows += [("test", "v", 1, 1, "a", 10.0, 99.0), ("test", "t", 1, 1, "a", 10.0, 10.0)]
    assert forecast.select_model(forecast.evaluate(spark.createDataFrame(rows, RESULT))).first()["model"] == "v"


def test_seasonal_model_learns_a_daily_cycle():
    hours = np.arange(24 * 12)
    y = 10 + 5 * np.sin(2 * np.pi * hours / 24) + np.random.default_rng(0).normal(0, 0.2, len(hours))
    found = sarimax.forecast(y[:-24], 24, 1, 1, 1)
    assert np.abs(found - y[-24:]).mean() < 0.6
    with pytest.raises(ValueError):
        sarimax.forecast(y[:30], 24, 1, 1, 1)


def test_orders_are_chosen_per_trigger(spark):
    rows = [(h, h % 24, t, 10 + 5 * np.sin(h / 24 * 2 * np.pi) * k, "train" if h < 240 else "validation") for h in range(288) for k, t in ((1, "a"), (2, "b"))]
    rows = [(h, d, t, float(y), s) for h, d, t, y, s in rows]
    found = sarimax.select_orders(spark.createDataFrame(rows, PANEL)).collect()
    assert sorted(r["Trigger"] for r in found) == ["a", "b"]


def test_recursive_features_equal_the_panel_features(spark):
    from tidegauge.operators import features
    from tidegauge.schema import FEATURES

    series = [float((h * 7) % 13 + 1) for h in range(120)]
    rows = [(h // 24 + 1, h % 24, h, "a", y) for h, y in enumerate(series)]
    panel_rows = spark.createDataFrame(rows, "trace_day int, hour_of_day int, hour_index int, Trigger string, compute_seconds double")
    want = features.engineer(panel_rows).where("hour_index = 119").first()
    found = gbdt.row_of(119, series[:119], series[95])
    assert found == pytest.approx([want[c] for c in FEATURES])


def test_the_declared_trees_grow_at_the_declared_rate():
    import pandas as pd

    from tidegauge.schema import FEATURES

    rng = np.random.default_rng(4)
    rows = pd.DataFrame(rng.normal(size=(400, len(FEATURES))), columns=list(FEATURES))
    rows = rows.assign(hour_index=np.arange(400), Trigger=np.where(np.arange(400) % 2, "a", "b"))
    rows["compute_seconds"] = np.where(rows["lag_1"] > 0, 10.0, 0.0) + 5 * (rows["Trigger"] == "a")
    for config in gbdt.CONFIGS:
        model = gbdt.fit(rows, ["a", "b"], config)
        assert len(model.trees) == config[3] == {"lgbm_1": 200, "lgbm_2": 300, "lgbm_3": 400, "lgbm_4": 400}[config[0]]
        x = np.column_stack([rows["Trigger"] == "b", rows[list(FEATURES)]]).astype(float)
        assert np.abs(model.predict(x) - rows["compute_seconds"]).max() < 0.5
        assert set(np.argsort(-model.gains)[:2]) == {0, 1 + FEATURES.index("lag_1")}


def test_trees_split_as_a_search_over_all_thresholds():
    from tidegauge.operators.leafwise import Trees

    rng = np.random.default_rng(6)
    x = np.column_stack([rng.integers(0, 3, 60), rng.integers(0, 9, 60)]).astype(float)
    y = rng.normal(size=60) + x[:, 1]
    model = Trees(x, y, leaves=2, rate=1.0, trees=1, least=5, share=1.0, penalty=1.0, seed=1)
    r, best = y - y.mean(), 0.0
    sides = [x[:, 1] <= k for k in range(9)] + [np.isin(x[:, 0], c) for c in ([0], [1], [2])]
    for side in sides:
        if 5 <= side.sum() <= 55:
            parts = sum(r[s].sum() ** 2 / (s.sum() + 1) for s in (side, ~side))
            best = max(best, parts - r.sum() ** 2 / 61)
    assert model.gains.sum() == pytest.approx(best)


def test_the_tree_configuration_is_the_one_of_least_validation_error(spark):
    from tidegauge.plans import pipeline

    error = {"lgbm_1": 3.0, "lgbm_2": 1.0, "lgbm_3": -1.0, "lgbm_4": 2.0}
    rows = [("validation", "LightGBM", c, h, h, 1, "a", 10.0, 10.0 + e, False) for c, e in error.items() for h in range(3)]
    assert pipeline.gbdt_choice(spark.createDataFrame(rows, gbdt.SCHEMA))[0] == "lgbm_2"


def test_a_comparison_refuses_to_leave_a_model_out(spark):
    rows = [(s, m, h, h, "a", 1.0, 1.0) for s in ("validation", "test") for m in ("x", "y") for h in range(2)]
    forecast.require_models(spark.createDataFrame(rows, RESULT), ("x", "y"))
    for wrong in (rows[:-1], rows + rows[-1:], rows[:6]):
        with pytest.raises(forecast.MissingModel):
            forecast.require_models(spark.createDataFrame(wrong, RESULT), ("x", "y"))
    with pytest.raises(forecast.MissingModel):
        forecast.require_models(spark.createDataFrame(rows, RESULT), ("x", "y", "z"))


def test_four_models_are_compared(spark, data):
    from tidegauge.catalog import QUERIES

    rows = QUERIES["bi_model_performance_all_models"](spark, data).collect()
    models = {"Seasonal Naive", "Historical Hour-of-Day Mean", "SARIMAX", "LightGBM"}
    found = {(r["model"], r["dataset_split"]) for r in rows}
    assert found == {(m, s) for m in models for s in ("validation", "test")}
    assert len(rows) == 4 * 2 * 6  # five triggers and the total


def test_a_trigger_without_any_fitting_order_raises(spark):
    rows = [(h, h % 24, "a", 1.0, "train" if h < 240 else "validation") for h in range(288)]
    rows += [(h, h % 24, "b", 1.0, "train" if h < 20 else "validation") for h in range(24)]
    with pytest.raises(Exception, match="no candidate order fits trigger b"):
        sarimax.select_orders(spark.createDataFrame(rows, PANEL)).collect()


def test_first_hours_must_have_the_stored_features():
    import pandas as pd

    from tidegauge.schema import FEATURES

    row = [float(k) for k in range(len(FEATURES))]
    panel_rows = pd.DataFrame([[5, "a", True, *row]], columns=["hour_index", "Trigger", "featured", *FEATURES])
    gbdt.require_stored_features(panel_rows, 5, "a", row)
    with pytest.raises(ValueError, match="differ from the stored ones"):
        gbdt.require_stored_features(panel_rows, 5, "a", [x + 1 for x in row])
