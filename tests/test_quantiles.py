"""Exact percentiles by rank selection and by two heaps against numpy; stored tables."""

import random
import time

import numpy as np
import pytest

from tidegauge.operators import quantiles
from tidegauge.sources import shared


def test_grouped_percentiles_equal_numpy(spark):
    rng = random.Random(1)
    groups = {
        "many": [rng.gauss(0, 5) for _ in range(3000)],
        "ties": [7.0] * 2000 + [rng.choice([1.0, 2.0, 9.0]) for _ in range(900)],
        "one": [3.5],
        "two": [1.0, 2.0],
        "negative": [-float(k) for k in range(101)],
    }
    rows = [(g, "k", x, "extra") for g, xs in groups.items() for x in xs] + [("ties", "k", None, "x"), ("none", "k", None, "x"), (None, "k", 4.0, "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, h string, value double, name string").repartition(5)
    shares = {"low": 0.0, "median": 0.5, "p95": 0.95, "top": 1.0}
    found = {r["g"]: r for r in quantiles.grouped_percentiles(df, ["g", "h"], "value", shares).collect()}
    assert set(found) - {None} == set(groups)
    for g, xs in groups.items():
        for name, share in shares.items():
            assert found[g][name] == pytest.approx(np.percentile(xs, share * 100), abs=1e-12), (g, name)
    assert quantiles.grouped_percentiles(df.limit(0), ["g", "h"], "value", shares).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_running_percentile_equals_numpy(share):
    rng = random.Random(2)
    seen, running = [], quantiles.RunningPercentile(share)
    assert running.value() is None
    for _ in range(700):
        x = rng.choice([rng.random(), float(rng.randrange(5))])
        seen.append(x)
        running.add(x)
        assert running.value() == pytest.approx(np.percentile(seen, share * 100), abs=1e-12)


def test_running_percentile_is_not_quadratic():
    def seconds(n):
        xs, running = np.random.default_rng(3).random(n).tolist(), quantiles.RunningPercentile(0.95)
        began = time.perf_counter()
        for x in xs:
            running.add(x)
            running.value()
        return time.perf_counter() - began

    seconds(2000)
    assert seconds(80_000) < 16 * max(seconds(10_000), 0.01)


def test_prior_percentile_reads_earlier_rows_only(spark):
    rng = random.Random(4)
    series = {t: [None if rng.random() < 0.1 else rng.random() for _ in range(60)] for t in "ab"}
    rows = [(t, h, x) for t, xs in series.items() for h, x in enumerate(xs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "Trigger string, hour_index int, y double")
    found = {(r[0], r[1]): r[2] for r in quantiles.prior_percentile(df, "Trigger", "hour_index", "y", 0.95, "p").collect()}
    for t, xs in series.items():
        for h in range(60):
            before = [x for x in xs[:h] if x is not None]
            want = np.percentile(before, 95) if before else None
            assert found[t, h] == (want if want is None else pytest.approx(want, abs=1e-12))


def test_stored_tables_are_shared_until_a_source_changes_or_they_are_released(spark, tmp_path):
    source, built = str(tmp_path / "in"), []
    spark.range(3).write.parquet(source)

    def build():
        built.append(1)
        return spark.read.parquet(source).selectExpr("id * 2 AS twice")

    one, two = (shared.stored(spark, "twice", [source], build) for _ in range(2))
    assert one.inputFiles() == two.inputFiles() and len(built) == 1 and sorted(r[0] for r in two.collect()) == [0, 2, 4]
    assert shared.stored(spark, "other", [source], build).inputFiles() != one.inputFiles()
    spark.range(3, 5).write.mode("append").parquet(source)
    assert shared.stored(spark, "twice", [source], build).count() == 5 and len(built) == 3
    folder = one.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    import os

    assert os.path.isdir(folder) and shared.release(spark) >= 3 and not os.path.exists(folder)
    assert shared.stored(spark, "twice", [source], build).count() == 5 and len(built) == 4
