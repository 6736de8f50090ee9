"""Future demand under forecast uncertainty, and the capacity that it asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions import compact
from tidegauge.operators.forecast import CRITERION, SELECTION, hourly_means
from tidegauge.operators.joins import matched
from tidegauge.schema import HEADROOMS, HORIZON, HOURLY_MEAN, LEAST_VECTORS, PERCENTILES, SEED, SHORTAGE_TARGET, SIMULATIONS, TOTAL
from tidegauge.sources.readers import document

DEMAND = "workload demand proxy in compute-seconds per hour"
CAPACITY = "required workload-serving capacity in normalized compute-seconds per hour"


class UnsupportedModel(ValueError):
    """The simulation has no point forecast for the selected model."""


class InvalidSelection(ValueError):
    """A selection document that does not say that validation data alone decided."""


def require_supported(selected: str, supported: tuple[str, ...] = (HOURLY_MEAN,)) -> None:
    """A model without a future point forecast must not be replaced in silence; where none are named, the hour-of-day mean alone has one."""
    if selected not in supported:
        raise UnsupportedModel(f"selected {selected!r}, only {', '.join(map(repr, supported))} can be simulated")


def selected_model(spark: SparkSession, path: str, supported: tuple[str, ...] = (HOURLY_MEAN,)) -> str:
    """The model of the selection document at ``path``: the simulation obeys it, or raises if it has no forecast for it."""
    record = document(spark, path, list(SELECTION))
    if record["selection_criterion"] != CRITERION or record["test_set_excluded_from_selection"] is not True:
        raise InvalidSelection(f"{path}: not selected by {CRITERION} without test data")
    require_supported(record["selected_model"], supported)
    return record["selected_model"]


def future_points(panel: DataFrame, hours: int) -> DataFrame:
    """The next day per trigger from means over all observed hours, and their sum."""
    means = hourly_means(panel)
    ahead = panel.sparkSession.range(1, HORIZON + 1).select(
        F.col("id").cast("int").alias("forecast_horizon_hour"),
        (F.lit(hours - 1) + F.col("id")).cast("int").alias("hour_index"),
        ((F.lit(hours - 1) + F.col("id")) % 24).cast("int").alias("hour_of_day"),
    )
    return points_of(means.join(F.broadcast(ahead), "hour_of_day"), "mean", HOURLY_MEAN)  # 24 rows


def next_day(panel: DataFrame, hours: int) -> DataFrame:
    """The panel with the hours of the next day, whose demand is null."""
    ahead = panel.select("Trigger").distinct().select(
        "Trigger", F.explode(F.sequence(F.lit(hours).cast("int"), F.lit(hours + HORIZON - 1).cast("int"))).alias("hour_index")
    )
    ahead = ahead.withColumns({"trace_day": (F.floor(F.col("hour_index") / 24) + 1).cast("int"), "hour_of_day": (F.col("hour_index") % 24).cast("int")})
    return panel.unionByName(ahead, allowMissingColumns=True)


def predicted_points(predictions: DataFrame, hours: int, model: str) -> DataFrame:
    """Future points from a model's predictions of the next day; every trigger must have one at every hour."""
    ahead = predictions.where((F.col("hour_index") >= hours) & (F.col("hour_index") < hours + HORIZON))
    missing = F.raise_error(F.concat(F.lit(f"{model}: no forecast for hour "), F.col("hour_index").cast("string"))).cast("double")
    value = F.coalesce("predicted_compute_seconds", missing)
    return points_of(ahead.withColumns({"forecast_horizon_hour": (F.col("hour_index") - hours + 1).cast("int"), "value": value}), "value", model)


def points_of(ahead: DataFrame, value: str, model: str) -> DataFrame:
    """Points by trigger and their sums, in the form that simulations read."""
    points = ahead.select(
        "forecast_horizon_hour", "hour_index", "hour_of_day", F.lit("trigger").alias("aggregation_level"), "Trigger",
        F.col(value).alias("point_forecast_compute_seconds"),
    )
    keys = ["forecast_horizon_hour", "hour_index", "hour_of_day"]
    total = points.groupBy(*keys).agg(F.sum("point_forecast_compute_seconds").alias("point_forecast_compute_seconds"))
    total = total.withColumns({"aggregation_level": F.lit("total_demand"), "Trigger": F.lit(TOTAL)})
    return points.unionByName(total).withColumns({"selected_model": F.lit(model), "demand_measure": F.lit(DEMAND)})


def residual_vectors(predictions: DataFrame, model: str = HOURLY_MEAN) -> DataFrame:
    """One row per held-out hour: number, hour and the errors of all triggers in order of trigger."""
    rows = predictions.where(F.col("model") == model).select(
        "hour_index", "hour_of_day", "Trigger",
        (F.col("actual_compute_seconds") - F.col("predicted_compute_seconds")).alias("residual"),
    )
    vectors = rows.groupBy("hour_index", "hour_of_day").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("Trigger", "residual"))), lambda x: x["residual"]).alias("residuals")
    )
    order = Window.orderBy("hour_index")  # 120 hours
    return vectors.withColumn("vector", F.row_number().over(order) - 1)


def enough_by_hour(vectors: DataFrame) -> bool:
    """Whether every hour of day has vectors enough to be sampled by itself."""
    row = vectors.groupBy("hour_of_day").count().agg(F.min("count"), F.count("*")).first()
    return row[1] == 24 and row[0] >= LEAST_VECTORS


def numbers(spark, simulations: int = SIMULATIONS) -> DataFrame:
    """(horizon, simulation, number): a number from a hash, equal on every run and engine."""
    grid = spark.range(HORIZON * simulations).select(
        (F.floor(F.col("id") / simulations) + 1).cast("int").alias("forecast_horizon_hour"),
        (F.col("id") % simulations).cast("int").alias("simulation"),
    )
    key = F.concat_ws(":", F.lit(str(SEED)), F.col("forecast_horizon_hour").cast("string"), F.col("simulation").cast("string"))
    return grid.withColumn("number", F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"))


def draws(spark, n_vectors: int, simulations: int = SIMULATIONS) -> DataFrame:
    """(horizon, simulation, vector): a draw with replacement among all vectors."""
    return numbers(spark, simulations).withColumn("vector", (F.col("number") % n_vectors).cast("int")).drop("number")


def draws_by_hour(points: DataFrame, vectors: DataFrame, simulations: int = SIMULATIONS) -> DataFrame:
    """(horizon, simulation, vector): a draw with replacement among the vectors of the same hour of day."""
    known = vectors.groupBy("hour_of_day").agg(F.array_sort(F.collect_list("vector")).alias("of_hour"))
    ahead = points.select("forecast_horizon_hour", "hour_of_day").distinct().join(known, "hour_of_day")
    drawn = numbers(points.sparkSession, simulations).join(F.broadcast(ahead), "forecast_horizon_hour")  # 24 rows
    place = F.get("of_hour", (F.col("number") % F.size("of_hour")).cast("int"))
    return drawn.select("forecast_horizon_hour", "simulation", place.alias("vector"))


def simulate(points: DataFrame, vectors: DataFrame, simulations: int = SIMULATIONS) -> DataFrame:
    """(horizon, simulation, demand by trigger, total): one vector for all triggers of a draw, clipped before they are summed.

    Vectors are drawn among those of the same hour of day if every hour has enough of them, else among all.
    Vectors (held-out hours) and points (24 hours) are bounded by calendar and are broadcast.
    """
    if enough_by_hour(vectors):
        drawn = draws_by_hour(points, vectors, simulations)
    else:
        drawn = draws(points.sparkSession, vectors.count(), simulations)
    by_hour = points.where("aggregation_level = 'trigger'").groupBy("forecast_horizon_hour").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("Trigger", "point_forecast_compute_seconds"))), lambda x: x["point_forecast_compute_seconds"]).alias("points")
    )
    joined = drawn.join(F.broadcast(vectors.select("vector", "residuals")), "vector").join(F.broadcast(by_hour), "forecast_horizon_hour")
    demand = F.zip_with("points", "residuals", lambda p, r: F.greatest(p + r, F.lit(0.0)))
    joined = joined.select("forecast_horizon_hour", "simulation", demand.alias("demand"))
    return joined.withColumn("total", F.aggregate("demand", F.lit(0.0), lambda a, x: a + x))


def intervals(points: DataFrame, simulated: DataFrame, triggers: list[str]) -> DataFrame:
    """Percentiles per trigger and of the total (of the sums, not sums of percentiles); points and percentiles match one to one, or reading raises."""
    share = F.array(*(F.lit(p / 100) for p in PERCENTILES))
    quantiles = simulated.groupBy("forecast_horizon_hour").agg(
        *(F.percentile(F.get("demand", k), share).alias(f"q{k}") for k in range(len(triggers))), F.percentile("total", share).alias("q")
    )
    named = F.array(
        *(F.struct(F.lit(t).alias("Trigger"), F.col(f"q{k}").alias("q")) for k, t in enumerate(triggers)),
        F.struct(F.lit(TOTAL).alias("Trigger"), F.col("q").alias("q")),
    )
    rows = quantiles.select("forecast_horizon_hour", F.explode(named).alias("x")).select("forecast_horizon_hour", "x.*")
    columns = [F.get("q", k).alias(f"simulated_P{p}_compute_seconds") for k, p in enumerate(PERCENTILES)]
    rows = rows.select("forecast_horizon_hour", "Trigger", *columns)
    return matched(points, rows, ["forecast_horizon_hour", "Trigger"], "points and percentiles").select(*points.columns, *rows.columns[2:])


def scenarios(points: DataFrame, simulated: DataFrame, headrooms: tuple[int, ...] = HEADROOMS) -> DataFrame:
    """Shortage and idle capacity per hour and headroom; demand equal to capacity is no shortage."""
    total = points.where("aggregation_level = 'total_demand'").select(
        "forecast_horizon_hour", "hour_index", "hour_of_day", "point_forecast_compute_seconds"
    )
    wide = total.withColumn("headroom_percent", F.explode(F.array(*map(F.lit, headrooms))))
    wide = wide.withColumn(
        "required_capacity_compute_seconds", F.col("point_forecast_compute_seconds") * (1 + F.col("headroom_percent") / 100.0)
    )
    rows = simulated.select("forecast_horizon_hour", "total").join(F.broadcast(wide), "forecast_horizon_hour")  # 240 rows
    gap = F.col("total") - F.col("required_capacity_compute_seconds")
    short = F.greatest(gap, F.lit(0.0))
    keys = wide.columns
    return rows.groupBy(*keys).agg(
        F.avg((short > 0).cast("double")).alias("shortage_probability"),
        F.avg(short).alias("expected_shortage_compute_seconds"),
        F.percentile(short, F.lit(0.95)).alias("p95_shortage_compute_seconds"),
        F.avg(F.greatest(-gap, F.lit(0.0))).alias("expected_unused_capacity"),
        F.count("*").cast("long").alias("simulation_count"),
    )


def recommendation(scenario_rows: DataFrame, target: float = SHORTAGE_TARGET) -> DataFrame:
    """Summary by headroom; the least headroom whose worst hour meets the target is flagged, none if none does."""
    summary = scenario_rows.groupBy("headroom_percent").agg(
        F.max("shortage_probability").alias("maximum_hourly_shortage_probability"),
        F.avg("shortage_probability").alias("average_shortage_probability"),
        F.sum("expected_shortage_compute_seconds").alias("expected_total_shortage"),
        F.avg("expected_unused_capacity").alias("average_unused_capacity"),
    )
    meets = F.col("maximum_hourly_shortage_probability") <= target
    least = F.min(F.when(meets, F.col("headroom_percent"))).over(Window.partitionBy(F.lit(0)))  # ten rows
    summary = summary.withColumn("best", least)
    status: Column = F.when(F.col("best").isNull(), "no tested headroom meets the target").otherwise(
        F.concat(F.lit("least tested headroom that meets the target: "), compact(F.col("best")), F.lit("%"))
    )
    return summary.select(
        "headroom_percent", "maximum_hourly_shortage_probability", "average_shortage_probability", "expected_total_shortage",
        "average_unused_capacity", F.lit(target).alias("service_target_maximum_hourly_shortage_probability"),
        meets.alias("meets_service_target"),
        F.coalesce(F.col("headroom_percent") == F.col("best"), F.lit(False)).alias("is_minimum_recommended_headroom"),
        F.col("best").cast("double").alias("minimum_recommended_headroom_percent"),
        status.alias("recommendation_status"), F.lit(CAPACITY).alias("capacity_measure"),
    )
