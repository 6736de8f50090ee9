"""Leakage-safe features of the hourly panel and its chronological split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidegauge.functions import hour_angle, null_share, ratio
from tidegauge.operators.quantiles import prior_percentile
from tidegauge.schema import FEATURES, LAGS, MEAN_WINDOWS, STD_WINDOWS, TEST_HOURS, VALIDATION_HOURS, WARMUP_HOURS

def by_trigger() -> WindowSpec:
    return Window.partitionBy("Trigger").orderBy("hour_index")


def prior(aggregate: Column, n: int, y: str = "compute_seconds") -> Column:
    """An aggregate over the ``n`` rows before the current one, null until there are so many."""
    frame = by_trigger().rowsBetween(-n, -1)
    return F.when(F.count(y).over(frame) == n, aggregate.over(frame))


def lags(panel: DataFrame, y: str = "compute_seconds") -> DataFrame:
    return panel.withColumns({f"lag_{k}": F.lag(y, k).over(by_trigger()) for k in LAGS})


def rolling(panel: DataFrame, y: str = "compute_seconds") -> DataFrame:
    columns = {f"rolling_mean_{n}": prior(F.avg(y), n, y) for n in MEAN_WINDOWS}
    columns |= {f"rolling_std_{n}": prior(F.stddev_samp(y), n, y) for n in STD_WINDOWS}
    columns |= {"rolling_max_24": prior(F.max(y), 24, y), "rolling_min_24": prior(F.min(y), 24, y)}
    return panel.withColumns(columns)


def load_ratio(panel: DataFrame, y: str = "compute_seconds") -> DataFrame:
    """Last hour against the 95th percentile of all earlier hours."""
    ranked = panel.join(prior_percentile(panel, "Trigger", "hour_index", y, 0.95, "prior_p95"), ["Trigger", "hour_index"], "left").select(*panel.columns, "prior_p95")
    return ranked.withColumn("historical_load_ratio", ratio(F.col("lag_1"), F.col("prior_p95")))


def trigger_share(panel: DataFrame) -> DataFrame:
    """Share of the trigger in the demand of the hour one day before."""
    total = F.sum("lag_24").over(Window.partitionBy("hour_index"))
    return panel.withColumn("lag24_trigger_share", ratio(F.col("lag_24"), total))


def temporal(panel: DataFrame) -> DataFrame:
    first = F.min("trace_day").over(Window.partitionBy("Trigger"))
    angle = hour_angle(F.col("hour_of_day"))
    return panel.withColumns(
        {"trace_day_index": (F.col("trace_day") - first).cast("int"), "hour_sin": F.sin(angle), "hour_cos": F.cos(angle)}
    )


def engineer(panel: DataFrame) -> DataFrame:
    """All features; those by trigger share one sort, only the cross-trigger share needs another exchange."""
    return trigger_share(load_ratio(rolling(lags(temporal(panel)))))


def labelled(panel: DataFrame, hours: int) -> DataFrame:
    """Adds ``split``: the last hours test, those before validate, the first are warm-up, the rest train."""
    h = F.col("hour_index")
    name = F.when(h >= hours - TEST_HOURS, "test").when(h >= hours - TEST_HOURS - VALIDATION_HOURS, "validation")
    return panel.withColumn("split", name.when(h >= WARMUP_HOURS, "train").otherwise("warmup"))


def split(featured: DataFrame, hours: int) -> DataFrame:
    """Adds ``split`` and drops the warm-up."""
    return labelled(featured.where(F.col("hour_index") >= WARMUP_HOURS), hours)


def model_features(panel: DataFrame, hours: int) -> DataFrame:
    return split(engineer(panel), hours).select("hour_index", "Trigger", "compute_seconds", *FEATURES, "split")


def split_summary(features: DataFrame, triggers: list[str]) -> DataFrame:
    """One wide row of bounds, counts and missing values."""
    out = [F.lit(WARMUP_HOURS).alias("warmup_hours"), F.count("*").cast("long").alias("observations_after_warmup")]
    names = {t: t.lower() for t in triggers}
    for s in ("train", "validation", "test"):
        mine = F.col("split") == s
        out += [
            F.min(F.when(mine, F.col("hour_index"))).cast("long").alias(f"{s}_start_hour_index"),
            F.max(F.when(mine, F.col("hour_index"))).cast("long").alias(f"{s}_end_hour_index"),
            F.count_if(mine).cast("long").alias(f"{s}_observations"),
            *(F.count_if(mine & (F.col("Trigger") == t)).cast("long").alias(f"{s}_{n}_observations") for t, n in names.items()),
        ]
    out += [F.count_if(F.col("Trigger") == t).cast("long").alias(f"{n}_observations") for t, n in names.items()]
    missing = sum((F.count_if(F.col(c).isNull()) for c in FEATURES[1:]), F.count_if(F.col(FEATURES[0]).isNull()))
    out += [
        missing.cast("long").alias("feature_missing_values_after_warmup"),
        F.try_divide(F.lit(100.0) * missing, F.count("*") * len(FEATURES)).alias("feature_missing_percentage_after_warmup"),
    ]
    for c in FEATURES:
        out += [
            F.count_if(F.col(c).isNull()).cast("long").alias(f"{c}_missing_values_after_warmup"),
            null_share(F.col(c)).alias(f"{c}_missing_percentage_after_warmup"),
        ]
    return features.agg(*out)
