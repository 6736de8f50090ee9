import pytest
from pyspark.sql import functions as F

from tidegauge.operators import demand

DURATION = "trace_day int, HashOwner string, HashApp string, HashFunction string, Average string, Count long"
CALLS = "trace_day int, HashOwner string, HashApp string, HashFunction string, Trigger string, hour_index int, calls long"


def test_duplicate_durations_are_weighted_and_invalid_ones_dropped(spark):
    rows = [(1, "o", "a", "f", "100", 1), (1, "o", "a", "f", "200", 3), (1, "o", "a", "f", "-1", 9), (1, "o", "a", "f", "x", 9)]
    found = demand.consolidate_durations(spark.createDataFrame(rows, DURATION)).collect()
    assert [r["average_ms"] for r in found] == [175.0]


def test_duplicate_metrics_count_rows_and_whole_keys(spark):
    rows = [(1, "o", "a", "f", "1", 1)] * 2 + [(1, "o", "b", "f", "1", 1)] + [(1, None, "c", "f", "1", 1)] * 3
    found = demand.duplicate_metrics(spark.createDataFrame(rows, DURATION), demand.FUNCTION_KEY, "d").first()
    assert (found[0], found[1]) == (5, 1)


def test_unmatched_calls_count_but_take_no_time(spark):
    calls = spark.createDataFrame([(1, "o", "a", "f", "http", 3, 5), (1, "o", "b", "g", "http", 3, 2)], CALLS)
    seconds = spark.createDataFrame([(1, "o", "b", "g", "500", 1)], DURATION)
    triggers = spark.createDataFrame([("http",), ("timer",)], "Trigger string")
    found = {(r["hour_index"], r["Trigger"]): r for r in demand.hourly_demand(calls, seconds, triggers, 24).collect()}
    assert len(found) == 48
    row = found[3, "http"]
    assert (row["invocations"], row["active_functions"], row["compute_seconds"]) == (7, 2, 1.0)
    assert row["invocation_weighted_average_duration_ms"] == 500.0
    assert found[4, "timer"]["invocation_weighted_average_duration_ms"] is None
    total = {r["hour_index"]: r for r in demand.hourly_totals(demand.hourly_demand(calls, seconds, triggers, 24), ["http"]).collect()}
    assert total[3]["invocation_share_http"] == 1.0 and total[4]["invocation_share_http"] is None


def test_missing_accounting(spark):
    calls = spark.createDataFrame([(1, "o", "a", "f", "http", 3, 5), (1, "o", "b", "g", "http", 3, 15)], CALLS)
    seconds = spark.createDataFrame([(1, "o", "b", "g", "500", 1)], DURATION)
    row = demand.missing_durations(calls, seconds).first()
    assert tuple(row) == (1, 50.0, 5, 25.0)


def test_trigger_labels(spark):
    rows = spark.createDataFrame([(" HTTP\t",), ("what",)], "Trigger string")
    found = {r["Trigger"]: r["code"] for r in demand.normalize_triggers(rows, ("timer", "http")).collect()}
    assert found == {"http": 1, "what": -1}


def test_minutes_become_hours(spark):
    minutes = [0.0] * 1440
    minutes[0], minutes[59], minutes[60], minutes[1439] = 1.0, 2.0, 4.0, 8.0
    wide = spark.createDataFrame([("f", minutes)], "f string, minutes array<double>")
    found = {r["hour_of_day"]: r["calls"] for r in demand.minutes_to_hours(wide).collect()}
    assert (found[0], found[1], found[2], found[23], len(found)) == (3.0, 4.0, 0.0, 8.0, 24)


def test_minutes_in_a_map_become_the_same_hours(spark):
    some = {0: 1.0, 59: 2.0, 60: 4.0, 1439: 8.0}
    dense = [[some.get(k, 0.0) for k in range(1440)], [1.0] * 1440, [0.0] * 1440]
    rows = [("f", some), ("g", dict(enumerate(dense[1]))), ("h", {})]
    sparse = demand.minutes_to_hours(spark.createDataFrame(rows, "f string, minutes map<int,double>"))
    wide = demand.minutes_to_hours(spark.createDataFrame(list(zip("fgh", dense)), "f string, minutes array<double>"))
    found = sorted(map(tuple, sparse.collect()))
    assert sparse.dtypes == wide.dtypes and found == sorted(map(tuple, wide.collect()))
    assert len(found) == 72 and found[23] == ("f", 23, 8.0) and found[24] == ("g", 0, 60.0) and found[48] == ("h", 0, 0.0)
    for minute in (-1, 1440):
        outside = spark.createDataFrame([("f", {minute: 1.0})], "f string, minutes map<int,double>")
        with pytest.raises(Exception, match=f"outside the day: minute {minute}"):
            demand.minutes_to_hours(outside).collect()


def test_minute_matrix_holds_only_minutes_with_calls(spark, data):
    from tidegauge.sources import adapter

    rows = adapter.minute_matrix(spark, data)
    assert dict(rows.dtypes)["minutes"] == "map<int,double>"
    assert "element_at" not in str(rows._jdf.queryExecution().optimizedPlan().toString())
    values = rows.select(F.explode(F.map_values("minutes")).alias("n"))
    assert tuple(values.agg(F.min("n") > 0, F.sum("n").cast("long")).first()) == (True, adapter.events(spark, data).count())


def test_memory_is_a_mean_of_applications(spark):
    rows = [(1, "o", "a", 1, 10.0), (1, "o", "a", 3, 20.0), (1, "o", "b", 1, 7.5)]
    memory = spark.createDataFrame(rows, "trace_day int, HashOwner string, HashApp string, SampleCount int, AverageAllocatedMb double")
    row = demand.memory_summary(memory).first()
    assert (row["application_count"], row["mean_allocated_mb"], row["median_allocated_mb"]) == (2, 12.5, 12.5)
    assert row["p95_allocated_mb"] == pytest.approx(17.0)


def test_raw_sums_reconcile_with_trigger_rows_and_totals(spark):
    from tidegauge.operators import demand as d
    from tidegauge.sources import adapter

    data = "/root/testdata/sf0.001"
    calls, seconds = adapter.invocations(spark, data), adapter.durations(spark, data)
    rows = d.hourly_demand(calls, seconds, adapter.vocabulary(spark), adapter.HOURS)
    totals = d.hourly_totals(rows, list(adapter.TRIGGERS))
    assert d.reconciled(calls, seconds, rows, totals).first()["reconciliation_passed"]
    lost = d.reconciled(calls, seconds, rows, totals.where("hour_index != 100")).first()
    assert not lost["reconciliation_passed"] and lost["max_hourly_invocation_difference"] > 0 and lost["raw_total_invocation_difference"] > 0


def test_quality_record_from_one_pass(spark):
    from tidegauge.operators import quality

    calls = [(1, "o", "a", "f", "http", 3, 5), (1, "o", "a", "f", "http", 4, 1), (1, "o", "b", "g", "http", 3, 2), (1, None, "c", "f", "timer", 0, 4)]
    seconds = [(1, "o", "b", "g", "500", 1), (1, "o", "b", "g", "-1", 9), (1, "o", "z", "z", "7", 1), (1, None, "c", "f", "9", 1), (1, None, "c", "f", "9", 1), (1, "o", "a", "f", "x", 2)]
    memory = [(1, "o", "a"), (1, "o", "a"), (1, "o", "b"), (1, None, "a"), (1, None, "a")]
    keys = ", ".join(f"{c} string" for c in ("HashOwner", "HashApp"))
    frames = spark.createDataFrame(calls, CALLS), spark.createDataFrame(seconds, DURATION), spark.createDataFrame(memory, f"trace_day int, {keys}")
    triggers = spark.createDataFrame([("http",), ("timer",)], "Trigger string")
    files = {"invocation": ("daily_csv", 14), "duration": ("feather", 1), "memory": ("daily_csv", 12)}
    row = quality.quality_record(*frames, triggers, ["http", "timer"], 48, files).first().asDict()
    assert len(row) == 32
    assert (row["invocation_source_row_count"], row["duration_source_row_count"], row["memory_source_row_count"]) == (4, 6, 5)
    assert (row["missing_duration_join_function_count"], row["missing_duration_join_invocation_count"]) == (2, 10)
    assert row["missing_duration_join_function_percentage"] == pytest.approx(200 / 3) and row["missing_duration_join_invocation_percentage"] == pytest.approx(1000 / 12)
    assert (row["duration_duplicate_row_count"], row["duration_duplicate_key_group_count"]) == (4, 1)
    assert (row["memory_duplicate_row_count"], row["memory_duplicate_key_group_count"], row["memory_unavailable_trace_days"]) == (4, 1, "2")
    assert (row["hourly_trigger_row_count"], row["hourly_total_row_count"], row["total_invocations"], row["total_compute_seconds"]) == (96, 48, 12, 1.0)
    assert row["reconciliation_passed"] and row["duration_source_layout"] == "feather" and row["invocation_source_file_count"] == 14
    none = quality.quality_record(*(f.limit(0) for f in frames), triggers, ["http", "timer"], 48, files).first().asDict()
    assert none["invocation_source_row_count"] == 0 and none["missing_duration_join_function_percentage"] is None
