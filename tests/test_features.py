import math

from pyspark.sql import functions as F

from tidegauge.operators import features

HOURS = 240


def panel(spark, changed=None):
    rows = [(h // 24 + 1, h % 24, h, t, float((h * 7 + k * 3) % 11 + (100 if changed == h else 0))) for h in range(HOURS) for k, t in enumerate("ab")]
    return spark.createDataFrame(rows, "trace_day int, hour_of_day int, hour_index int, Trigger string, compute_seconds double")


def test_features_do_not_see_their_own_hour_or_later(spark):
    def upto(rows):
        out = features.engineer(rows).where("hour_index <= 150").drop("compute_seconds").orderBy("hour_index", "Trigger")
        return [tuple(r) for r in out.collect()]

    assert upto(panel(spark)) == upto(panel(spark, changed=150))


def test_rolling_windows_wait_for_enough_rows(spark):
    rows = {r["hour_index"]: r for r in features.rolling(panel(spark).where("Trigger = 'a'")).collect()}
    y = [float((h * 7) % 11) for h in range(HOURS)]
    assert rows[2]["rolling_mean_3"] is None and rows[3]["rolling_mean_3"] == sum(y[:3]) / 3
    m = sum(y[4:10]) / 6
    assert math.isclose(rows[10]["rolling_std_6"], math.sqrt(sum((v - m) ** 2 for v in y[4:10]) / 5))
    assert rows[23]["rolling_max_24"] is None and rows[24]["rolling_max_24"] == max(y[:24])


def test_split_is_chronological(spark):
    found = features.split(panel(spark), HOURS).groupBy("split").agg(F.min("hour_index"), F.max("hour_index")).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == {"train": (72, 119), "validation": (120, 167), "test": (168, 239)}


def test_summary_counts_nulls(spark):
    row = features.split_summary(features.model_features(panel(spark), HOURS), ["a", "b"]).first()
    assert row["observations_after_warmup"] == 336 and row["test_a_observations"] == 72
    assert row["feature_missing_values_after_warmup"] == 0


def test_shares_are_null_without_demand(spark):
    rows = panel(spark).withColumn("compute_seconds", F.lit(0.0))
    found = features.engineer(rows).where("hour_index > 100")
    assert found.where("lag24_trigger_share is not null or historical_load_ratio is not null").count() == 0
