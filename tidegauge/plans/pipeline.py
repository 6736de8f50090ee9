"""The stages over the driver's event table: each function plans one named result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import capacity, checks, demand, features, forecast, gbdt, quality, reports, sarimax
from tidegauge.schema import GBDT, HEADROOMS, HORIZON, HOURLY_MEAN, SARIMAX, SEASONAL, TEST_HOURS, VALIDATION_HOURS
from tidegauge.sources import adapter, sinks
from tidegauge.sources.shared import materialize, source_state, stored, stored_path
from tidegauge.streaming import hourly

HOURS = adapter.HOURS
MODELS = (SEASONAL, HOURLY_MEAN, SARIMAX, GBDT)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, ties up: engines sum in different orders, and a tie could fall either way."""
    return df.select(*(F.round(F.col(c) + 1e-9, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def hourly_demand(spark: SparkSession, d: str) -> DataFrame:
    return demand.hourly_demand(adapter.invocations(spark, d), adapter.durations(spark, d), adapter.vocabulary(spark), HOURS)


def hourly_total(spark: SparkSession, d: str) -> DataFrame:
    return demand.hourly_totals(hourly_demand(spark, d), list(adapter.TRIGGERS))


def duration_consolidation(spark: SparkSession, d: str) -> DataFrame:
    return demand.consolidate_durations(adapter.durations(spark, d))


def duration_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return demand.duplicate_metrics(adapter.durations(spark, d), adapter.FUNCTION, "duration")


def missing_duration_accounting(spark: SparkSession, d: str) -> DataFrame:
    return demand.missing_durations(adapter.invocations(spark, d), adapter.durations(spark, d))


def daily_memory(spark: SparkSession, d: str) -> DataFrame:
    return demand.memory_summary(adapter.memory(spark, d))


def data_quality(spark: SparkSession, d: str) -> DataFrame:
    files = ("parquet", len(source_state(spark, adapter.events_path(d))))
    sources = (adapter.invocations(spark, d), adapter.durations(spark, d), adapter.memory(spark, d))
    layout = dict.fromkeys(("invocation", "duration", "memory"), files)
    return quality.quality_record(*sources, adapter.vocabulary(spark), list(adapter.TRIGGERS), HOURS, layout)


def demand_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    rows = stored_demand(spark, d)
    totals = demand.hourly_totals(rows, list(adapter.TRIGGERS))
    return demand.reconciled(adapter.invocations(spark, d), adapter.durations(spark, d), rows, totals)


def minute_reshape(spark: SparkSession, d: str) -> DataFrame:
    hours = demand.minutes_to_hours(adapter.minute_matrix(spark, d))
    return hours.groupBy("trace_day", "Trigger", "hour_of_day").agg(
        F.sum("calls").cast("long").alias("calls"), F.count_if(F.col("calls") > 0).cast("long").alias("active_functions")
    )


def trigger_normalization(spark: SparkSession, d: str) -> DataFrame:
    raw = adapter.events(spark, d).select(F.concat(F.lit(" \t"), F.upper("Trigger"), F.lit("\t ")).alias("Trigger"))
    return demand.normalize_triggers(raw, adapter.TRIGGERS).groupBy("Trigger", "code").agg(F.count("*").alias("n"))


def lag_features(spark: SparkSession, d: str) -> DataFrame:
    return features.lags(hourly_demand(spark, d)).select("hour_index", "Trigger", *(f"lag_{k}" for k in features.LAGS))


def rolling_features(spark: SparkSession, d: str) -> DataFrame:
    rows = features.rolling(hourly_demand(spark, d))
    return rows.select("hour_index", "Trigger", *(c for c in rows.columns if c.startswith("rolling_")))


def expanding_load_ratio(spark: SparkSession, d: str) -> DataFrame:
    rows = features.load_ratio(features.lags(hourly_demand(spark, d)))
    return rows.select("hour_index", "Trigger", "prior_p95", "historical_load_ratio")


def lag24_share(spark: SparkSession, d: str) -> DataFrame:
    return features.trigger_share(features.lags(hourly_demand(spark, d))).select("hour_index", "Trigger", "lag24_trigger_share")


def temporal_features(spark: SparkSession, d: str) -> DataFrame:
    return features.temporal(hourly_demand(spark, d)).select("hour_index", "Trigger", "hour_sin", "hour_cos", "trace_day_index")


def model_features(spark: SparkSession, d: str) -> DataFrame:
    return features.model_features(hourly_demand(spark, d), HOURS)


def chronological_split(spark: SparkSession, d: str) -> DataFrame:
    return features.split(hourly_demand(spark, d), HOURS).groupBy("split", "Trigger").agg(
        F.min("hour_index").alias("first_hour"), F.max("hour_index").alias("last_hour"), F.count("*").alias("hours"),
        F.countDistinct("hour_index").alias("distinct_hours"),
    )


def split_summary(spark: SparkSession, d: str) -> DataFrame:
    return features.split_summary(model_features(spark, d), list(adapter.TRIGGERS))


def stored_demand(spark: SparkSession, d: str) -> DataFrame:
    """The hourly panel (hours x triggers) as a table: the queries of a session aggregate the same events once."""
    return stored(spark, "hourly-demand", [adapter.events_path(d)], lambda: hourly_demand(spark, d))


def panel(spark: SparkSession, d: str) -> DataFrame:
    """The stored hourly panel with its split, warm-up hours as 'warmup'."""
    return features.labelled(stored_demand(spark, d), HOURS)


def hourly_mean_of(rows: DataFrame) -> DataFrame:
    one = forecast.hour_of_day_mean(rows, "validation", HOURLY_MEAN)
    return one.unionByName(forecast.hour_of_day_mean(rows, "test", HOURLY_MEAN))


def predictions_of(rows: DataFrame) -> DataFrame:
    """Both baselines over both splits of a labelled panel."""
    one, two = forecast.seasonal_fixed_origin(rows, "validation", SEASONAL), forecast.seasonal_walk_forward(rows, "test", SEASONAL)
    return one.unionByName(two).unionByName(hourly_mean_of(rows))


def seasonal_validation(spark: SparkSession, d: str) -> DataFrame:
    return forecast.seasonal_fixed_origin(panel(spark, d), "validation", SEASONAL)


def seasonal_test(spark: SparkSession, d: str) -> DataFrame:
    return forecast.seasonal_walk_forward(panel(spark, d), "test", SEASONAL)


def hourly_mean(spark: SparkSession, d: str) -> DataFrame:
    return hourly_mean_of(panel(spark, d))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return predictions_of(panel(spark, d))


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return forecast.evaluate(predictions(spark, d))


def stored_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A few rows a model and trigger, read several times by rankings."""
    return materialize(metrics(spark, d), "metrics")


def ranking(spark: SparkSession, d: str) -> DataFrame:
    return forecast.rank_models(stored_metrics(spark, d))


def ranking_by_trigger(spark: SparkSession, d: str) -> DataFrame:
    return forecast.rank_by_trigger(stored_metrics(spark, d))


def selection(spark: SparkSession, d: str) -> DataFrame:
    return forecast.selection_record(metrics(spark, d))


def selected_predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions(spark, d)
    return forecast.selected_predictions(rows, forecast.evaluate(rows))


def capacity_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Future points and residual vectors of the hour-of-day mean, which the caller asks for by name; nothing is selected."""
    rows = panel(spark, d)
    return capacity.future_points(rows.drop("split"), HOURS), capacity.residual_vectors(hourly_mean_of(rows), HOURLY_MEAN)


def selected_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Future points and residual vectors of the model that the stored selection among all four names."""
    model = capacity.selected_model(spark, selection_document(spark, d), MODELS)
    return model_points(spark, d, model), capacity.residual_vectors(all_predictions(spark, d), model)


def model_points(spark: SparkSession, d: str, model: str) -> DataFrame:
    """The next day by one of the four models, from all observed hours."""
    base = stored_demand(spark, d)
    if model == HOURLY_MEAN:
        return capacity.future_points(base, HOURS)
    ahead = capacity.next_day(base, HOURS)
    future = F.when(F.col("hour_index") >= HOURS, "future").otherwise(F.col("split"))
    rows = features.labelled(ahead, HOURS).withColumn("split", future)
    if model == SEASONAL:
        found = forecast.seasonal_fixed_origin(rows, "future", SEASONAL)
    elif model == SARIMAX:
        found = sarimax.predict(rows.where("split != 'warmup'"), "future", sarimax_orders(spark, d))
    else:
        known = features.model_features(ahead, HOURS).withColumn("split", future)
        found = gbdt.rolling(known, ahead, "future", (gbdt_choice(gbdt_validation(spark, d)),))
    return capacity.predicted_points(found, HOURS, model)


def points_all_models(spark: SparkSession, d: str) -> DataFrame:
    return selected_inputs(spark, d)[0]


def intervals_all_models(spark: SparkSession, d: str) -> DataFrame:
    ahead, errors = selected_inputs(spark, d)
    return capacity.intervals(ahead, capacity.simulate(ahead, errors), list(adapter.TRIGGERS))


def scenarios_all_models(spark: SparkSession, d: str) -> DataFrame:
    ahead, errors = selected_inputs(spark, d)
    return capacity.scenarios(ahead, capacity.simulate(ahead, errors))


def recommended_all_models(spark: SparkSession, d: str) -> DataFrame:
    return capacity.recommendation(scenarios_all_models(spark, d))


def points(spark: SparkSession, d: str) -> DataFrame:
    return capacity_inputs(spark, d)[0]


def residuals(spark: SparkSession, d: str) -> DataFrame:
    named = [F.get("residuals", k).alias(f"residual_{t}") for k, t in enumerate(adapter.TRIGGERS)]
    return capacity_inputs(spark, d)[1].select("vector", "hour_index", "hour_of_day", *named)


def bootstrap_demand(spark: SparkSession, d: str) -> DataFrame:
    return capacity.simulate(*capacity_inputs(spark, d)).groupBy("forecast_horizon_hour").agg(
        F.count("*").alias("simulations"), F.avg("total").alias("mean_total"), F.min("total").alias("least_total"), F.max("total").alias("most_total")
    )


def intervals(spark: SparkSession, d: str) -> DataFrame:
    ahead, errors = capacity_inputs(spark, d)
    return capacity.intervals(ahead, capacity.simulate(ahead, errors), list(adapter.TRIGGERS))


def scenarios(spark: SparkSession, d: str) -> DataFrame:
    ahead, errors = capacity_inputs(spark, d)
    return capacity.scenarios(ahead, capacity.simulate(ahead, errors))


def recommended(spark: SparkSession, d: str) -> DataFrame:
    return capacity.recommendation(scenarios(spark, d))


def day_set_difference(spark: SparkSession, d: str) -> DataFrame:
    return checks.day_difference(adapter.memory(spark, d), range(1, HOURS // 24 + 1))


def constraint_report(spark: SparkSession, d: str) -> DataFrame:
    """(rule, violations) of every constraint that data alone decides."""
    calls, seconds, mb, rows = adapter.invocations(spark, d), adapter.durations(spark, d), adapter.memory(spark, d), stored_demand(spark, d)
    featured, found = features.model_features(rows, HOURS), predictions_of(features.labelled(rows, HOURS))
    ahead, errors = capacity.future_points(rows, HOURS), capacity.residual_vectors(found)
    drawn = capacity.simulate(ahead, errors)
    tested = materialize(capacity.scenarios(ahead, drawn), "scenarios")
    triggers, scored = list(adapter.TRIGGERS), materialize(forecast.evaluate(found), "metrics")
    forecasts = materialize(capacity.intervals(ahead, drawn, triggers), "intervals")
    parts = [
        checks.invocation_rules(calls, adapter.TRIGGERS),
        checks.duration_rules(seconds),
        checks.memory_rules(mb),
        checks.panel_rules(rows, HOURS),
        checks.history_rules(rows, HOURS, len(triggers)),
        checks.reconciliation(rows, demand.hourly_totals(rows, triggers), calls),
        checks.feature_rules(featured),
        checks.model_input_rules(featured),
        checks.split_rules(featured, VALIDATION_HOURS, TEST_HOURS),
        checks.prediction_rules(found),
        checks.metric_rules(scored, 2, len(triggers)),
        checks.selection_rules(forecast.selection_record(scored)),
        checks.future_rules(forecasts, tested, HORIZON, len(triggers), len(HEADROOMS)),
        checks.capacity_rules(ahead, forecasts, tested, capacity.recommendation(tested)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def bi_demand_history(spark: SparkSession, d: str) -> DataFrame:
    return reports.demand_history(hourly_demand(spark, d))


def bi_model_performance(spark: SparkSession, d: str) -> DataFrame:
    return reports.model_performance(metrics(spark, d))


def bi_forecast_vs_actual(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions(spark, d)
    chosen = forecast.select_model(forecast.evaluate(rows)).first()
    return reports.forecast_vs_actual(rows, chosen["model"], {"baseline_forecast": SEASONAL})


def all_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Validation and test predictions of the four compared models (models x hours x triggers), computed once in a session for the same events."""
    return stored(spark, "predictions", [adapter.events_path(d)], lambda: four_models(spark, d))


def selection_document(spark: SparkSession, d: str) -> str:
    """Where the selection among the four models lies as a JSON document."""
    record = lambda path: sinks.json_document(selection_all_models(spark, d), path)
    return stored_path(spark, "selection", [adapter.events_path(d)], record)


def four_models(spark: SparkSession, d: str) -> DataFrame:
    base = stored_demand(spark, d)
    whole = features.labelled(base, HOURS)
    rows, known = whole.where("split != 'warmup'"), features.model_features(base, HOURS)
    orders = sarimax_orders(spark, d)
    validated = gbdt_validation(spark, d)
    chosen = gbdt_choice(validated)
    parts = [
        sarimax.predict(rows, "validation", orders),
        sarimax.predict(rows, "test", orders),
        validated.where(F.col("candidate_id") == chosen[0]),
        gbdt.rolling(known, base, "test", (chosen,)),
    ]
    out = predictions_of(whole)
    for part in parts:
        out = out.unionByName(part.select(*forecast.RESULT))
    found = materialize(out, "predictions")
    forecast.require_models(found, MODELS)
    return found


def metrics_all_models(spark: SparkSession, d: str) -> DataFrame:
    return forecast.evaluate(all_predictions(spark, d))


def ranking_all_models(spark: SparkSession, d: str) -> DataFrame:
    return forecast.rank_models(metrics_all_models(spark, d))


def ranking_by_trigger_all_models(spark: SparkSession, d: str) -> DataFrame:
    return forecast.rank_by_trigger(metrics_all_models(spark, d))


def selection_all_models(spark: SparkSession, d: str) -> DataFrame:
    return forecast.selection_record(metrics_all_models(spark, d))


def selected_predictions_all_models(spark: SparkSession, d: str) -> DataFrame:
    rows = all_predictions(spark, d)
    return forecast.selected_predictions(rows, forecast.evaluate(rows))


def bi_model_performance_all_models(spark: SparkSession, d: str) -> DataFrame:
    return reports.model_performance(metrics_all_models(spark, d))


def versus_all_models(rows: DataFrame) -> DataFrame:
    chosen = forecast.select_model(forecast.evaluate(rows)).first()
    columns = {"baseline_forecast": SEASONAL, "SARIMAX_forecast": SARIMAX, "LightGBM_forecast": GBDT}
    return reports.forecast_vs_actual(rows, chosen["model"], columns)


def bi_forecast_vs_actual_all_models(spark: SparkSession, d: str) -> DataFrame:
    return versus_all_models(all_predictions(spark, d))


def measure_kpis_all_models(spark: SparkSession, d: str) -> DataFrame:
    rows = all_predictions(spark, d)
    return reports.kpis(versus_all_models(rows), reports.model_performance(forecast.evaluate(rows)), recommended_all_models(spark, d))


def visual_test_metrics_all_models(spark: SparkSession, d: str) -> DataFrame:
    rows = bi_model_performance_all_models(spark, d)
    mae, rmse, wape = (reports.test_metric_by_model(rows, m) for m in ("MAE", "RMSE", "WAPE"))
    return mae.join(rmse, "model").join(wape, "model")


def visual_forecasts_by_hour_all_models(spark: SparkSession, d: str) -> DataFrame:
    rows = bi_forecast_vs_actual_all_models(spark, d)
    return reports.forecasts_by_hour(rows, ["baseline_forecast", "SARIMAX_forecast", "LightGBM_forecast"])


def bi_future_forecast(spark: SparkSession, d: str) -> DataFrame:
    return reports.future_forecast(intervals(spark, d))


def bi_capacity_scenarios(spark: SparkSession, d: str) -> DataFrame:
    return reports.capacity_scenarios(scenarios(spark, d))


def measure_kpis(spark: SparkSession, d: str) -> DataFrame:
    return reports.kpis(bi_forecast_vs_actual(spark, d), bi_model_performance(spark, d), recommended(spark, d))


def bi_table_violations(spark: SparkSession, d: str) -> DataFrame:
    """The contract of the six published tables, counted on one stored panel and one simulation."""
    base = stored_demand(spark, d)
    found = predictions_of(features.labelled(base, HOURS))
    scored = materialize(forecast.evaluate(found), "metrics")
    chosen = forecast.select_model(scored).first()["model"]  # of the two baselines, which the table compares
    ahead, errors = capacity.future_points(base, HOURS), capacity.residual_vectors(found)
    drawn = capacity.simulate(ahead, errors)
    tested = materialize(capacity.scenarios(ahead, drawn), "scenarios")
    tables = {
        "demand_history": reports.demand_history(base),
        "model_performance": reports.model_performance(scored),
        "forecast_vs_actual": reports.forecast_vs_actual(found, chosen, {"baseline_forecast": SEASONAL}),
        "future_forecast": reports.future_forecast(capacity.intervals(ahead, drawn, list(adapter.TRIGGERS))),
        "capacity_scenarios": reports.capacity_scenarios(tested),
        "capacity_recommendation": capacity.recommendation(tested),
    }
    return reports.table_report(tables)


def visual_actual_vs_selected(spark: SparkSession, d: str) -> DataFrame:
    return reports.actual_vs_selected(bi_forecast_vs_actual(spark, d))


def visual_actual_by_trigger(spark: SparkSession, d: str) -> DataFrame:
    return reports.actual_by_trigger(bi_forecast_vs_actual(spark, d))


def visual_trigger_slice(spark: SparkSession, d: str) -> DataFrame:
    return reports.actual_vs_selected(bi_forecast_vs_actual(spark, d), "click")


def visual_test_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = bi_model_performance(spark, d)
    mae, rmse, wape = (reports.test_metric_by_model(rows, m) for m in ("MAE", "RMSE", "WAPE"))
    return mae.join(rmse, "model").join(wape, "model")


def visual_forecasts_by_hour(spark: SparkSession, d: str) -> DataFrame:
    return reports.forecasts_by_hour(bi_forecast_vs_actual(spark, d), ["baseline_forecast"])


def visual_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    return reports.uncertainty_by_hour(bi_future_forecast(spark, d))


def visual_recommended_by_hour(spark: SparkSession, d: str) -> DataFrame:
    return reports.recommended_by_hour(bi_capacity_scenarios(spark, d), recommended(spark, d))


def visual_shortage_by_headroom(spark: SparkSession, d: str) -> DataFrame:
    rows = recommended(spark, d)
    worst = reports.by_headroom(rows, "maximum_hourly_shortage_probability")
    return worst.join(reports.by_headroom(rows, "expected_total_shortage"), "headroom_percent")


def sarimax_orders(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, "orders", [adapter.events_path(d)], lambda: sarimax.select_orders(sarimax_panel(spark, d)))


def sarimax_panel(spark: SparkSession, d: str) -> DataFrame:
    """The panel from the end of the warm-up: history of this model starts there."""
    return panel(spark, d).where("split != 'warmup'")


def sarimax_test(spark: SparkSession, d: str) -> DataFrame:
    rows = sarimax_panel(spark, d)
    return sarimax.predict(rows, "test", sarimax_orders(spark, d))


def sarimax_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return sarimax.diagnostics(sarimax_test(spark, d))


def gbdt_validation(spark: SparkSession, d: str) -> DataFrame:
    """Validation predictions of every declared configuration, computed once in a session for the same events."""
    base = stored_demand(spark, d)
    plan = lambda: gbdt.rolling(features.model_features(base, HOURS), base, "validation", gbdt.CONFIGS)
    return stored(spark, "validation", [adapter.events_path(d)], plan)


def gbdt_choice(validated: DataFrame) -> tuple:
    """The declared configuration with least total validation WAPE, the first of equals."""
    found = forecast.evaluate(validated.withColumn("model", F.col("candidate_id"))).where("aggregation_level = 'total_demand'")
    scores = {r["model"]: r["WAPE"] for r in found.collect()}
    if any(scores.get(config[0]) is None for config in gbdt.CONFIGS):
        raise ValueError("a configuration has no validation WAPE")
    return min(gbdt.CONFIGS, key=lambda config: scores[config[0]])


def gbdt_test(spark: SparkSession, d: str) -> DataFrame:
    base = stored_demand(spark, d)
    chosen = gbdt_choice(gbdt_validation(spark, d))
    return gbdt.rolling(features.model_features(base, HOURS), base, "test", (chosen,))


def gbdt_importance(spark: SparkSession, d: str) -> DataFrame:
    """Gains of the model that precedes the test hours."""
    base = stored_demand(spark, d)
    return gbdt.importance(features.model_features(base, HOURS), gbdt_choice(gbdt_validation(spark, d)))


def visual_feature_importance(spark: SparkSession, d: str) -> DataFrame:
    return reports.importance_by_feature(gbdt_importance(spark, d))


def streaming_hourly(spark: SparkSession, d: str) -> DataFrame:
    return hourly.replay(spark, d).select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "events")

