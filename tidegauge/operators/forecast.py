"""Baseline forecasts, their metrics, and the choice among models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import close, ratio
from tidegauge.operators.features import by_trigger
from tidegauge.operators.joins import found
from tidegauge.schema import TOTAL

RESULT = ("split", "model", "hour_index", "hour_of_day", "Trigger", "actual_compute_seconds", "predicted_compute_seconds")


#: The selection document's criterion and fields.
CRITERION = "lowest aggregated validation WAPE"
SELECTION = ("selected_model", "validation_MAE", "validation_RMSE", "validation_WAPE", "selection_criterion", "test_set_excluded_from_selection")


def formatted(rows: DataFrame, split: str, model: str, predicted: Column) -> DataFrame:
    return rows.select(
        F.lit(split).alias("split"), F.lit(model).alias("model"), "hour_index", "hour_of_day", "Trigger",
        F.col("compute_seconds").alias("actual_compute_seconds"), predicted.alias("predicted_compute_seconds"),
    )


def seasonal_fixed_origin(panel: DataFrame, split: str, model: str) -> DataFrame:
    """Every hour of the split repeats the last whole day before the split: no hour of the split is read.

    In closed form hour t takes hour t - 24k with the least k that leads before the split.
    """
    rows = panel.where(F.col("split") == split)
    origin = rows.agg(F.min("hour_index").alias("origin"))
    asked = rows.join(F.broadcast(origin), F.lit(True))  # one row
    back = 24 * (F.floor((F.col("hour_index") - F.col("origin")) / 24) + 1)
    asked = asked.withColumn("source", (F.col("hour_index") - back).cast("int"))
    history = panel.select(F.col("hour_index").alias("source"), "Trigger", F.col("compute_seconds").alias("before"))
    return formatted(asked.join(history, ["source", "Trigger"], "left"), split, model, F.col("before"))


def seasonal_walk_forward(panel: DataFrame, split: str, model: str) -> DataFrame:
    """The value 24 hours earlier, observed hours of the split included."""
    before = panel.withColumn("before", F.lag("compute_seconds", 24).over(by_trigger()))
    return formatted(before.where(F.col("split") == split), split, model, F.col("before"))


def hourly_means(rows: DataFrame) -> DataFrame:
    return rows.groupBy("Trigger", "hour_of_day").agg(F.avg("compute_seconds").alias("mean"))


def hour_of_day_mean(panel: DataFrame, split: str, model: str) -> DataFrame:
    """Mean of the TRAIN hours with the same hour of day; a row without such hours raises when it is made."""
    means = hourly_means(panel.where("split = 'train'"))
    rows = found(panel.where(F.col("split") == split), means, ["Trigger", "hour_of_day"], "mean", model)
    return formatted(rows, split, model, F.col("mean"))


def metrics(by: list[str]) -> tuple[Column, ...]:
    error = F.col("predicted_compute_seconds") - F.col("actual_compute_seconds")
    size = F.sum(F.abs(error))
    return (
        F.avg(F.abs(error)).alias("MAE"),
        F.sqrt(F.avg(error * error)).alias("RMSE"),
        ratio(size, F.sum(F.abs("actual_compute_seconds"))).alias("WAPE"),
    )


def evaluate(predictions: DataFrame) -> DataFrame:
    """MAE, RMSE and WAPE per trigger, and of the sums by hour: the total is not a mean of triggers."""
    keys = ["split", "model"]
    one = predictions.groupBy(*keys, "Trigger").agg(*metrics(keys)).withColumn("aggregation_level", F.lit("trigger"))
    summed = predictions.groupBy(*keys, "hour_index").agg(
        F.sum("actual_compute_seconds").alias("actual_compute_seconds"),
        F.sum("predicted_compute_seconds").alias("predicted_compute_seconds"),
    )
    whole = summed.groupBy(*keys).agg(*metrics(keys)).withColumns({"Trigger": F.lit(TOTAL), "aggregation_level": F.lit("total_demand")})
    order = [*keys, "aggregation_level", "Trigger", "MAE", "RMSE", "WAPE"]
    return one.select(*order).unionByName(whole.select(*order))


class MissingModel(ValueError):
    """A model that must be compared has no or other predictions."""


def require_models(predictions: DataFrame, models: tuple[str, ...]) -> None:
    """Every model must predict the same hours and triggers of both splits, once each."""
    keys = ["split", "hour_index", "Trigger"]
    cells = predictions.groupBy("split", "model").agg(F.count("*").alias("n"), F.countDistinct(*keys).alias("distinct"))
    whole = {r["split"]: r["n"] for r in predictions.select(*keys).distinct().groupBy("split").agg(F.count("*").alias("n")).collect()}
    seen = {(r["split"], r["model"]): (r["n"], r["distinct"]) for r in cells.collect()}
    for split in ("validation", "test"):
        for model in models:
            if not whole.get(split) or seen.get((split, model)) != (whole[split], whole[split]):
                raise MissingModel(f"{model}: {split} predictions are missing or repeated")


def rank_models(evaluated: DataFrame) -> DataFrame:
    """Total metrics with the rank of validation WAPE (ties share the lowest) and the selection."""
    total = evaluated.where(F.col("Trigger") == TOTAL)
    chosen = select_model(evaluated).select(F.col("model").alias("chosen"))
    ranks = total.where("split = 'validation'").select(
        "model", F.rank().over(Window.orderBy(F.col("WAPE").asc_nulls_last())).cast("int").alias("validation_wape_rank")
    )  # one row a model
    joined = total.join(ranks, "model", "left").join(F.broadcast(chosen), F.lit(True))
    return joined.select(
        "split", "model", "MAE", "RMSE", "WAPE", "validation_wape_rank", (F.col("model") == F.col("chosen")).alias("selected_on_validation")
    )


def rank_by_trigger(evaluated: DataFrame) -> DataFrame:
    """Trigger metrics with the models' overall rank and selection."""
    order = rank_models(evaluated).where("split = 'validation'").select("model", "validation_wape_rank", "selected_on_validation")
    return evaluated.where(F.col("Trigger") != TOTAL).join(F.broadcast(order), "model").select(
        "split", "Trigger", "model", "MAE", "RMSE", "WAPE", "validation_wape_rank", "selected_on_validation"
    )


def select_model(evaluated: DataFrame) -> DataFrame:
    """The model with least validation WAPE; ties by MAE, RMSE, name. Test rows are not read."""
    rows = evaluated.where((F.col("Trigger") == TOTAL) & (F.col("split") == "validation"))
    order = [F.col(c).asc_nulls_last() for c in ("WAPE", "MAE", "RMSE", "model")]
    return rows.orderBy(*order).limit(1).select("model", "MAE", "RMSE", "WAPE")


def selection_record(evaluated: DataFrame) -> DataFrame:
    """The selection as a document of one row."""
    return select_model(evaluated).select(
        F.col("model").alias("selected_model"),
        F.col("MAE").alias("validation_MAE"),
        F.col("RMSE").alias("validation_RMSE"),
        F.col("WAPE").alias("validation_WAPE"),
        F.lit(CRITERION).alias("selection_criterion"),
        F.lit(True).alias("test_set_excluded_from_selection"),
    )


def reconcile(published: DataFrame, recomputed: DataFrame, rtol: float = 1e-10, atol: float = 1e-6) -> DataFrame:
    """Published metric rows that recomputation does not confirm, and recomputed ones that were not published."""
    keys = ["split", "model", "aggregation_level", "Trigger"]
    names = ["MAE", "RMSE", "WAPE"]
    other = recomputed.select(*keys, *(F.col(m).alias(f"again_{m}") for m in names), F.lit(True).alias("again"))
    both = published.withColumn("published", F.lit(True)).join(other, keys, "full")
    equal = F.col("published") & F.col("again")
    for m in names:
        a, b = F.col(m), F.col(f"again_{m}")
        equal = equal & F.coalesce(close(a, b, rtol, atol), a.isNull() & b.isNull())
    return both.where(~F.coalesce(equal, F.lit(False))).select(*keys)


def selected_predictions(predictions: DataFrame, evaluated: DataFrame) -> DataFrame:
    chosen = F.broadcast(select_model(evaluated).select("model"))  # one row
    return predictions.where("split = 'test'").join(chosen, "model").select(*RESULT)
