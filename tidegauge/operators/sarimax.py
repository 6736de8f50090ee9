"""Seasonal autoregression with moving-average terms, one model per trigger and order.

The estimator is our own two-stage least squares (a long autoregression gives
the innovations, then one regression on lags, seasonal lags, their products and
lagged innovations). The protocol is the reference's: rolling windows of a day,
actual values joined to the history only after a window, orders chosen on
validation data, frozen on test data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import tuple_label
from tidegauge.operators.forecast import evaluate
from tidegauge.schema import HORIZON, SARIMAX

#: Candidate orders (p, d, q) and seasonal orders (P, D, Q, s).
ORDERS = ((1, 0, 0), (1, 0, 1), (2, 0, 1))
SEASONAL_ORDERS = ((1, 0, 0, 24), (1, 0, 1, 24))
PREDICTION = (
    "Trigger string, p int, q int, sq int, split string, hour_index int, hour_of_day int, actual_compute_seconds double, "
    "predicted_compute_seconds double, forecast_window int, was_clipped_to_zero boolean"
)


def lag_sets(p: int, q: int, sq: int, season: int = HORIZON) -> tuple[list[int], list[int]]:
    """Lags of the series and of the innovations in the product form of the model."""
    own = [*range(1, p + 1), season, *(season + k for k in range(1, p + 1))]
    shocks = [*range(1, q + 1), *([season, *(season + k for k in range(1, q + 1))] if sq else [])]
    return own, shocks


def design(y: np.ndarray, e: np.ndarray, own: list[int], shocks: list[int], at: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(at)), *(y[at - k] for k in own), *(e[at - k] for k in shocks)])


def least_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    penalty = 1e-3 * len(y) * np.eye(x.shape[1])
    penalty[0, 0] = 1e-9
    return np.linalg.solve(x.T @ x + penalty, x.T @ y)


def forecast(history: np.ndarray, steps: int, p: int, q: int, sq: int) -> np.ndarray:
    """Unclipped forecast of the next ``steps`` values."""
    scale = max(float(np.mean(np.abs(history))), 1.0)
    y = history / scale
    own, shocks = lag_sets(p, q, sq)
    deep = max([*own, *shocks])
    if len(y) <= deep + len(own) + len(shocks) + 1:
        raise ValueError("history is too short for a daily season")
    at = np.arange(deep, len(y))
    e = np.zeros(len(y))
    long_lags = sorted({*own, *range(1, 4), HORIZON - 1})
    first = design(y, e, long_lags, [], at)
    e[at] = y[at] - first @ least_squares(first, y[at])
    x = design(y, e, own, shocks, at)
    weights = least_squares(x, y[at])
    y, e = np.append(y, np.zeros(steps)), np.append(e, np.zeros(steps))
    for t in range(len(history), len(y)):
        y[t] = (design(y, e, own, shocks, np.array([t])) @ weights)[0]
    return y[len(history) :] * scale


def rolling(pdf: pd.DataFrame, split: str, order: tuple[int, int, int]) -> pd.DataFrame:
    """All windows of a day of one trigger's split; earlier windows' actual values are history for later ones."""
    pdf = pdf.sort_values("hour_index")
    start = int(np.flatnonzero(pdf["split"].to_numpy() == split)[0])
    end = int(np.flatnonzero(pdf["split"].to_numpy() == split)[-1]) + 1
    y = pdf["compute_seconds"].to_numpy(dtype=float)
    out = []
    for window, lo in enumerate(range(start, end, HORIZON), 1):
        raw = forecast(y[:lo], min(HORIZON, end - lo), *order)
        rows = pdf.iloc[lo : lo + len(raw)][["Trigger", "hour_index", "hour_of_day"]].copy()
        rows["actual_compute_seconds"] = y[lo : lo + len(raw)]
        rows["predicted_compute_seconds"] = np.maximum(raw, 0.0)
        rows["was_clipped_to_zero"], rows["forecast_window"] = raw < 0, window
        out.append(rows)
    return pd.concat(out).assign(split=split, p=order[0], q=order[1], sq=order[2])


def candidates(panel: DataFrame, split: str, orders: DataFrame) -> DataFrame:
    """Predictions of (Trigger, order) pairs; a candidate that fails has no rows. A group is one trigger's hours."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in PREDICTION.split(", ")]
        try:
            return rolling(pdf, split, (int(key[1]), int(key[2]), int(key[3])))[columns]
        except (ValueError, np.linalg.LinAlgError):
            return pd.DataFrame(columns=columns)

    rows = panel.select("Trigger", "hour_index", "hour_of_day", "compute_seconds", "split").join(F.broadcast(orders), "Trigger")
    return rows.groupBy("Trigger", "p", "q", "sq").applyInPandas(run, PREDICTION)


def labelled(predictions: DataFrame) -> DataFrame:
    order = tuple_label(F.col("p"), F.lit(0), F.col("q"))
    seasonal = tuple_label(F.lit(1), F.lit(0), F.col("sq"), F.lit(HORIZON))
    return predictions.withColumns({"model": F.lit(SARIMAX), "order": order, "seasonal_order": seasonal})


def select_orders(panel: DataFrame) -> DataFrame:
    """Per trigger the order with least validation WAPE (earliest declared of equals); no candidate left raises when read."""
    grid = [(p, q, s[2], k) for k, ((p, _, q), s) in enumerate((o, s) for o in ORDERS for s in SEASONAL_ORDERS)]
    orders = panel.sparkSession.createDataFrame(grid, "p int, q int, sq int, ordinal int")
    triggers = panel.select("Trigger").distinct()
    found = candidates(panel, "validation", triggers.join(F.broadcast(orders), F.lit(True)).drop("ordinal"))
    scored = found.withColumn("model", F.concat_ws(":", "p", "q", "sq"))
    metrics = evaluate(scored).where("aggregation_level = 'trigger'").select("Trigger", "model", "MAE", "RMSE", "WAPE")
    keyed = metrics.join(F.broadcast(orders.withColumn("model", F.concat_ws(":", "p", "q", "sq"))), "model")
    best = Window.partitionBy("Trigger").orderBy(F.col("WAPE").asc_nulls_last(), "ordinal")
    chosen = keyed.withColumn("n", F.row_number().over(best)).where("n = 1").select("Trigger", "p", "q", "sq", "MAE", "RMSE", "WAPE")
    none = F.raise_error(F.concat(F.lit("no candidate order fits trigger "), F.col("Trigger"))).cast("int")
    every = triggers.join(chosen, "Trigger", "left")
    return every.withColumn("p", F.when(F.col("p").isNull(), none).otherwise(F.col("p"))).select(*chosen.columns)


def predict(panel: DataFrame, split: str, chosen: DataFrame) -> DataFrame:
    """Predictions with each trigger's frozen order."""
    return labelled(candidates(panel, split, chosen.select("Trigger", "p", "q", "sq")))


def diagnostics(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("Trigger", "order", "seasonal_order").agg(
        F.count("*").cast("long").alias("predictions"),
        F.count_if("was_clipped_to_zero").cast("long").alias("clipped_predictions"),
        F.countDistinct("forecast_window").cast("long").alias("windows"),
    )
