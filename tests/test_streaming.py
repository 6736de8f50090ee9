import datetime as dt

from tidegauge.streaming import hourly

SCHEMA = "ts timestamp, event_type string"


def events(spark, *rows):
    return spark.createDataFrame([(dt.datetime.fromisoformat(t), k) for t, k in rows], SCHEMA)


def counts(df):
    return sorted((r["hour"].isoformat(), r["event_type"], r["events"]) for r in df.collect())


def test_a_new_file_adds_its_parts_only(spark, tmp_path):
    source, state, progress = (str(tmp_path / n) for n in ("in", "parts", "progress"))
    events(spark, ("2024-01-01T00:10", "view"), ("2024-01-01T00:50", "view"), ("2024-01-02T05:00", None)).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    hourly.follow(stream, state, progress).awaitTermination()
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "parts").rglob("*.parquet")}
    assert len(before) == 2  # a file a day
    # late and new events of a second file
    events(spark, ("2024-01-01T00:59", "view"), ("2024-01-03T01:00", "view")).coalesce(1).write.mode("append").parquet(source)
    hourly.follow(stream, state, progress).awaitTermination()
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "parts").rglob("*.parquet")}
    assert before.items() <= after.items() and len(after) == 4
    found = hourly.merged(spark, state)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, map(tuple, hourly.partial_counts(spark.read.parquet(source)).collect())))
    assert counts(hourly.merged(spark, state, since="2024-01-03")) == [("2024-01-03T01:00:00", "view", 1)]
    plan = hourly.merged(spark, state, since="2024-01-03")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    rows = events(spark, ("2024-01-01T00:10", "view"))
    for _ in range(2):
        hourly.add_part(rows, str(tmp_path / "s"), 0)
    hourly.add_part(rows, str(tmp_path / "s"), 1)
    assert counts(hourly.merged(spark, str(tmp_path / "s"))) == [("2024-01-01T00:00:00", "view", 2)]
