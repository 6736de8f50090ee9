"""One gradient-boosted tree model over all triggers, forecast hour by hour from its own predictions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.leafwise import Trees
from tidegauge.schema import FEATURES, GBDT, HORIZON, LAGS, MEAN_WINDOWS, STD_WINDOWS

#: Declared candidates (name, leaves, learning rate, trees, least rows of a leaf, share of features, L2 term).
CONFIGS = (
    ("lgbm_1", 15, 0.05, 200, 20, 0.9, 1.0),
    ("lgbm_2", 31, 0.05, 300, 20, 0.9, 1.0),
    ("lgbm_3", 15, 0.03, 400, 10, 1.0, 0.0),
    ("lgbm_4", 31, 0.03, 400, 30, 0.8, 2.0),
)
SCHEMA = (
    "split string, model string, candidate_id string, hour_index int, hour_of_day int, forecast_window int, Trigger string, "
    "actual_compute_seconds double, predicted_compute_seconds double, was_clipped_to_zero boolean"
)
GAINS = "rank int, feature string, gain double, gain_percentage double"


def fit(rows: pd.DataFrame, triggers: list[str], config: tuple, seed: int = 42) -> Trees:
    """The declared number of trees at the declared rate over the rows without nulls."""
    _, leaves, rate, trees, least, share, penalty = config
    rows = rows.dropna(subset=list(FEATURES)).sort_values(["hour_index", "Trigger"])
    x = np.column_stack([rows["Trigger"].map({t: k for k, t in enumerate(triggers)}), rows[list(FEATURES)]]).astype(float)
    y = rows["compute_seconds"].to_numpy(dtype=float)
    return Trees(x, y, leaves=leaves, rate=rate, trees=trees, least=least, share=share, penalty=penalty, seed=seed)


def mean(x: list[float]) -> float:
    return sum(x) / len(x)


def deviation(x: list[float]) -> float:
    m = mean(x)
    return math.sqrt(sum((v - m) ** 2 for v in x) / (len(x) - 1))


def percentile(x: list[float], share: float) -> float:
    x, at = sorted(x), share * (len(x) - 1)
    low = math.floor(at)
    return x[low] + (x[min(low + 1, len(x) - 1)] - x[low]) * (at - low)


def row_of(hour: int, series: list[float], day_before: float) -> list[float]:
    """The features of the hour after ``series`` (whole history of one trigger); nulls become 0."""
    angle = 2 * math.pi * (hour % 24) / 24
    top = percentile(series, 0.95)
    return [
        hour % 24, math.sin(angle), math.cos(angle), hour // 24, *(series[-k] for k in LAGS), *(mean(series[-n:]) for n in MEAN_WINDOWS),
        *(deviation(series[-n:]) for n in STD_WINDOWS), max(series[-24:]), min(series[-24:]),
        series[-1] / top if top > 0 else 0.0, series[-24] / day_before if day_before > 0 else 0.0,
    ]


def require_stored_features(panel: pd.DataFrame, hour: int, trigger: str, found: list[float]) -> None:
    """The features made for a window's first hour, where all history is observed, must be the stored ones."""
    stored = panel[panel["featured"] & (panel["hour_index"] == hour) & (panel["Trigger"] == trigger)]
    want = stored[list(FEATURES)].fillna(0.0).to_numpy(dtype=float)
    if len(want) and not np.allclose(want, [found], rtol=1e-9, atol=1e-9):
        raise ValueError(f"features of hour {hour}, trigger {trigger} differ from the stored ones")


def window(panel: pd.DataFrame, split: str, config: tuple, number: int, lo: int, hi: int) -> pd.DataFrame:
    """Fit on what precedes ``lo``, then predict hour by hour until ``hi``; all triggers advance together."""
    triggers = sorted(panel["Trigger"].unique())
    model = fit(panel[panel["featured"] & (panel["hour_index"] < lo)], triggers, config)
    actual = {(t, h): y for t, h, y in zip(panel["Trigger"], panel["hour_index"], panel["compute_seconds"])}
    history = {t: [actual[t, h] for h in range(lo)] for t in triggers}
    out = []
    for hour in range(lo, hi + 1):
        day_before = sum(history[t][-24] for t in triggers)
        rows = [row_of(hour, history[t], day_before) for t in triggers]
        if hour == lo:
            for t, row in zip(triggers, rows):
                require_stored_features(panel, lo, t, row)
        raw = model.predict(np.array([[code, *row] for code, row in enumerate(rows)], dtype=float))
        for t, v in zip(triggers, raw.tolist()):
            history[t].append(max(v, 0.0))
            out.append((split, GBDT, config[0], hour, hour % 24, number, t, actual[t, hour], max(v, 0.0), v < 0))
    return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def whole_panel(features: DataFrame, demand: DataFrame) -> DataFrame:
    """Every hour's demand, with its features where it has some."""
    known = features.select("hour_index", "Trigger", *FEATURES, F.lit(True).alias("featured"))
    joined = demand.select("hour_index", "Trigger", "compute_seconds").join(known.withColumnRenamed("hour_of_day", "_hour"), ["hour_index", "Trigger"], "left")
    return joined.withColumnRenamed("_hour", "hour_of_day").withColumn("featured", F.coalesce("featured", F.lit(False)))


def rolling(features: DataFrame, demand: DataFrame, split: str, configs: tuple) -> DataFrame:
    """Windows of a day, each refit on what precedes it. One configuration's window is a task; a task holds the panel (hours x triggers)."""
    bounds = features.where(F.col("split") == split).agg(F.min("hour_index"), F.max("hour_index")).first()
    starts = range(bounds[0], bounds[1] + 1, HORIZON)
    rows = [(k, n, lo, min(lo + HORIZON - 1, bounds[1])) for k in range(len(configs)) for n, lo in enumerate(starts, 1)]
    spark = features.sparkSession
    jobs = spark.createDataFrame(rows, "config int, number int, lo int, hi int")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return window(pdf, split, configs[int(key[0])], int(key[1]), int(key[2]), int(key[3]))

    asked = whole_panel(features, demand).join(F.broadcast(jobs), F.col("hour_index") <= F.col("hi"))
    return asked.repartition(4 * len(rows), "config", "number").groupBy("config", "number", "lo", "hi").applyInPandas(run, SCHEMA)


def importance(features: DataFrame, config: tuple) -> DataFrame:
    """(rank, feature, gain, gain_percentage) of the fit on all hours before the test hours: normalised gain of every predictor, ties in predictor order."""
    names = ["Trigger", *FEATURES]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gains = fit(pdf, sorted(pdf["Trigger"].unique()), config).gains
        gains = gains / (gains.sum() or 1.0)
        order = sorted(range(len(names)), key=lambda k: -gains[k])
        out = [(n, names[k], gains[k], 100 * gains[k]) for n, k in enumerate(order, 1)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in GAINS.split(", ")])

    return features.where("split != 'test'").groupBy().applyInPandas(run, GAINS)
