"""Registry of the queries for demand forecasting and capacity risk, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegauge.plans import pipeline as p
from tidegauge.plans.oracle import ORACLE

Query = Callable[[SparkSession, str], DataFrame]


def _rounded(plan: Query) -> Query:
    return lambda spark, sf_dir: p.rounded(plan(spark, sf_dir))


QUERIES: dict[str, Query] = {
    name: _rounded(plan)
    for name, plan in {
        "hourly_demand_by_trigger": p.hourly_demand,
        "hourly_total_demand": p.hourly_total,
        "duration_consolidation": p.duration_consolidation,
        "duration_duplicates": p.duration_duplicates,
        "missing_duration_accounting": p.missing_duration_accounting,
        "daily_memory_summary": p.daily_memory,
        "data_quality_summary": p.data_quality,
        "demand_reconciliation": p.demand_reconciliation,
        "minute_to_hour_reshape": p.minute_reshape,
        "trigger_normalization": p.trigger_normalization,
        "lag_features": p.lag_features,
        "rolling_features": p.rolling_features,
        "expanding_load_ratio": p.expanding_load_ratio,
        "lag24_trigger_share": p.lag24_share,
        "temporal_features": p.temporal_features,
        "model_features": p.model_features,
        "chronological_split": p.chronological_split,
        "split_summary": p.split_summary,
        "seasonal_naive_fixed_origin": p.seasonal_validation,
        "seasonal_naive_walk_forward": p.seasonal_test,
        "hour_of_day_mean_forecast": p.hourly_mean,
        "baseline_metrics": p.metrics,
        "model_ranking": p.ranking,
        "model_ranking_by_trigger": p.ranking_by_trigger,
        "model_selection": p.selection,
        "selected_test_predictions": p.selected_predictions,
        "future_point_forecast": p.points,
        "residual_vectors": p.residuals,
        "bootstrap_demand": p.bootstrap_demand,
        "forecast_intervals": p.intervals,
        "capacity_scenarios": p.scenarios,
        "capacity_recommendation": p.recommended,
        "day_set_difference": p.day_set_difference,
        "constraint_report": p.constraint_report,
        "bi_demand_history": p.bi_demand_history,
        "bi_model_performance": p.bi_model_performance,
        "bi_forecast_vs_actual": p.bi_forecast_vs_actual,
        "bi_forecast_vs_actual_all_models": p.bi_forecast_vs_actual_all_models,
        "model_metrics_all_models": p.metrics_all_models,
        "model_ranking_all_models": p.ranking_all_models,
        "model_ranking_by_trigger_all_models": p.ranking_by_trigger_all_models,
        "model_selection_all_models": p.selection_all_models,
        "selected_test_predictions_all_models": p.selected_predictions_all_models,
        "bi_model_performance_all_models": p.bi_model_performance_all_models,
        "measure_kpis_all_models": p.measure_kpis_all_models,
        "visual_test_metrics_all_models": p.visual_test_metrics_all_models,
        "visual_forecasts_by_hour_all_models": p.visual_forecasts_by_hour_all_models,
        "future_point_forecast_all_models": p.points_all_models,
        "forecast_intervals_all_models": p.intervals_all_models,
        "capacity_scenarios_all_models": p.scenarios_all_models,
        "capacity_recommendation_all_models": p.recommended_all_models,
        "bi_future_forecast": p.bi_future_forecast,
        "bi_capacity_scenarios": p.bi_capacity_scenarios,
        "bi_capacity_recommendation": p.recommended,
        "bi_table_violations": p.bi_table_violations,
        "measure_kpis": p.measure_kpis,
        "visual_actual_vs_selected": p.visual_actual_vs_selected,
        "visual_actual_by_trigger": p.visual_actual_by_trigger,
        "visual_trigger_slice": p.visual_trigger_slice,
        "visual_test_metrics": p.visual_test_metrics,
        "visual_forecasts_by_hour": p.visual_forecasts_by_hour,
        "visual_uncertainty": p.visual_uncertainty,
        "visual_recommended_by_hour": p.visual_recommended_by_hour,
        "visual_shortage_by_headroom": p.visual_shortage_by_headroom,
        "sarimax_selected_orders": p.sarimax_orders,
        "sarimax_forecast": p.sarimax_test,
        "sarimax_diagnostics": p.sarimax_diagnostics,
        "gbdt_recursive_forecast": p.gbdt_test,
        "gbdt_feature_importance": p.gbdt_importance,
        "visual_feature_importance": p.visual_feature_importance,
        "streaming_hourly_demand": p.streaming_hourly,
    }.items()
}

__all__ = ["ORACLE", "QUERIES", "Query"]
