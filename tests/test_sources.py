import json

import pyarrow as pa
import pytest
from pyarrow import feather

from tidegauge.sources import contracts, readers, sinks

SCHEMA = "HashApp string, Trigger string, `1` double"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_daily_csvs_take_their_day_from_the_name(spark, tmp_path):
    write(tmp_path / "a/x.d01.csv", "HashApp,Trigger,1\nf,http,2\n")
    write(tmp_path / "b/x.d12.csv", "HashApp,Trigger,1\ng,timer,3\n")
    layout, paths = readers.discover(spark, str(tmp_path), "x.d*.csv", "x*.feather")
    assert layout == "csv" and len(paths) == 2
    rows = readers.daily_csv(spark, paths, SCHEMA, ["HashApp", "1"]).collect()
    assert {(r["HashApp"], r["1"], r["trace_day"]) for r in rows} == {("f", 2.0, 1), ("g", 3.0, 12)}


def test_layouts_must_be_clear(spark, tmp_path):
    with pytest.raises(readers.SourceError):
        readers.discover(spark, str(tmp_path), "x.d*.csv", "x*.feather")
    write(tmp_path / "x.d01.csv", "a\n1\n")
    write(tmp_path / "x.feather", "x")
    with pytest.raises(readers.SourceError):
        readers.discover(spark, str(tmp_path), "x.d*.csv", "x*.feather")
    (tmp_path / "x.feather").unlink()
    write(tmp_path / "again/x.d01.csv", "a\n1\n")
    with pytest.raises(readers.SourceError):
        readers.discover(spark, str(tmp_path), "x.d*.csv", "x*.feather")


def test_file_sets_and_headers(spark, tmp_path):
    for name in ("a/x.d01.csv", "b/x.d01.csv", "x.d09.csv"):
        write(tmp_path / name, "k,v\n1,2\n")
    found = readers.file_report(spark, str(tmp_path), "x.d*.csv", ["x.d01.csv", "x.d02.csv"]).collect()
    assert {tuple(r) for r in found} == {("x.d01.csv", "duplicate"), ("x.d02.csv", "missing"), ("x.d09.csv", "unexpected")}
    assert readers.missing_columns(spark, str(tmp_path / "x.d09.csv"), ["k", "w"]) == ["w"]


def test_daily_names_are_padded():
    assert readers.day_files("x.d*.csv", 12)[::11] == ["x.d01.csv", "x.d12.csv"]


def test_trigger_samples_must_pass(spark, tmp_path):
    texts = {"good": "k,Trigger\n1,HTTP \n2,timer\n", "bad": "k,Trigger\n1,http\n2,\n3,coffee\n", "bare": "k,Trigger\n", "none": "", "other": "k,v\n1,2\n"}
    for name, text in texts.items():
        write(tmp_path / f"{name}.csv", text)
    paths = [str(tmp_path / f"{name}.csv") for name in texts]
    report = readers.trigger_report(spark, paths, ["http", "timer"])
    found = {r["path"].rsplit("/", 1)[-1][:-4]: (r["n_rows"], r["invalid"], r["state"]) for r in report.collect()}
    assert found == {
        "good": (2, [], "pass"), "bad": (3, ["<blank>", "coffee"], "incompatible"), "bare": (0, [], "empty"), "none": (0, [], "empty"),
        "other": (0, [], "no column"),
    }
    with pytest.raises(readers.SourceError, match="bare.csv: empty"):
        readers.require_triggers(report)
    readers.require_triggers(report.where("state = 'pass'"))
    cut = readers.trigger_report(spark, paths[1:2], ["http", "timer"], rows=1).first()
    assert (cut["n_rows"], cut["state"]) == (1, "pass")


def test_feather_scan_projects(spark, tmp_path):
    table = pa.table({"HashApp": ["f", "g"], "day": pa.array([1, 2], pa.int64()), "unused": [0.0, 1.0]})
    with pa.ipc.new_file(str(tmp_path / "x.feather"), table.schema) as out:
        out.write_table(table, max_chunksize=1)
    rows = readers.feather(spark, [str(tmp_path / "x.feather")], "HashApp string, day long").collect()
    assert sorted(map(tuple, rows)) == [("f", 1), ("g", 2)]


@pytest.mark.parametrize("compression", [None, "lz4", "zstd"])
def test_feather_batches_are_spread_over_tasks(spark, tmp_path, compression):
    path = str(tmp_path / "x.feather")
    n = 10_000
    table = pa.table({"day": pa.array([k % 3 + 1 for k in range(n)], pa.int16()), "unused": ["x" * 50] * n, "HashApp": pa.array([str(k) for k in range(n)]).dictionary_encode(), "v": [None, 1.5] * (n // 2)})
    feather.write_feather(table, path, compression=compression or "uncompressed", chunksize=500)
    rows = readers.daily_feather(spark, path, "HashApp string, v double", batches=2)
    assert rows.columns == ["HashApp", "v", "trace_day"] and rows.rdd.getNumPartitions() == 10
    assert rows.groupBy("trace_day").count().where("count between 3333 and 3334").count() == 3
    assert rows.agg({"HashApp": "max", "v": "sum"}).first().asDict() == {"max(HashApp)": "9999", "sum(v)": 1.5 * n / 2}
    with pytest.raises(Exception, match="no missing"):
        readers.feather(spark, ["file:" + path], "missing string").collect()


def test_empty_feather_files_have_no_rows(spark, tmp_path):
    feather.write_feather(pa.table({"a": pa.array([], pa.int64())}), str(tmp_path / "x.feather"))
    assert readers.feather(spark, [str(tmp_path / "x.feather")], "a long").count() == 0


def test_csv_under_a_type_contract(spark, tmp_path):
    declared = {"trigger": "text", "forecast_hour": "whole", "P50": "decimal", "meets_service_target": "flag"}
    write(tmp_path / "good.csv", "trigger,P50,forecast_hour,meets_service_target\n7,1,3,true\n8,,4,false\n")
    whole = contracts.typed_csv(spark, str(tmp_path / "good.csv"), declared)
    good = whole.drop(contracts.CORRUPT)
    assert sorted(good.select("trigger", "P50", "forecast_hour", "meets_service_target").collect()) == [("7", 1.0, 3, True), ("8", None, 4, False)]
    assert contracts.wrong_types(good) == [] and {r[contracts.CORRUPT] for r in whole.collect()} == {None}
    write(tmp_path / "bad.csv", "trigger,P50,forecast_hour,meets_service_target\na,1.5,x,true\nb,2.5,4,maybe\nc,0.5,5,true\n")
    with pytest.raises(readers.SourceError, match="1 values of forecast_hour are not whole, 1 values of meets_service_target are not flag"):
        contracts.typed_csv(spark, str(tmp_path / "bad.csv"), declared)
    kept = {r["trigger"]: r for r in contracts.typed_csv(spark, str(tmp_path / "bad.csv"), declared, strict=False).collect()}
    assert kept["a"]["forecast_hour"] is None and kept["a"]["_corrupt_record"] == "a,1.5,x,true" and kept["c"]["_corrupt_record"] is None
    with pytest.raises(readers.SourceError, match="P50"):
        contracts.typed_csv(spark, str(tmp_path / "good.csv"), {k: v for k, v in declared.items() if k != "P50"})
    assert dict(contracts.inferred_csv(spark, str(tmp_path / "good.csv")).dtypes)["meets_service_target"] == "boolean"
    write(tmp_path / "none.csv", "trigger,P50,forecast_hour,meets_service_target\n")
    assert contracts.typed_csv(spark, str(tmp_path / "none.csv"), declared).count() == 0
    assert contracts.wrong_types(spark.createDataFrame([("1", 2.5)], "forecast_hour string, hour_index double")) == ["forecast_hour", "hour_index"]


def test_headers_and_samples(spark, tmp_path):
    write(tmp_path / "h.csv", "﻿HashApp,Trigger\nf,http\ng,\nh,http\n")
    assert readers.header(spark, str(tmp_path / "h.csv")) == ["HashApp", "Trigger"]
    found = {r["Trigger"]: r["count"] for r in readers.trigger_sample(spark, str(tmp_path / "h.csv")).collect()}
    assert found == {"http": 2, "<blank>": 1}
    write(tmp_path / "empty.csv", "")
    with pytest.raises(readers.SourceError):
        readers.header(spark, str(tmp_path / "empty.csv"))


def test_splits_are_pruned(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train"), (5, "train"), (9, "test")], "hour_index int, split string")
    sinks.parquet(rows, str(tmp_path / "features"), ["split"])
    found = readers.split_rows(spark, str(tmp_path / "features"), "train", upto=4)
    assert [r["hour_index"] for r in found.collect()] == [1]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "LessThanOrEqual(hour_index,4)" in plan


def test_reports_are_one_sorted_file(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "k int, x string").repartition(2)
    sinks.report_csv(rows, str(tmp_path / "r"), ["k"])
    assert (tmp_path / "r").read_text().splitlines() == ["k,x", "1,a", "2,b"]
    sinks.report_csv(rows.limit(0), str(tmp_path / "r"), ["k"])
    assert (tmp_path / "r").read_text().splitlines() == ["k,x"]
    assert {p.name.strip(".") for p in tmp_path.iterdir() if not p.name.endswith(".crc")} == {"r"}


def test_documents(spark, tmp_path):
    sinks.json_document(spark.createDataFrame([("m", 0.5)], "selected_model string, wape double"), str(tmp_path / "d"))
    assert readers.document(spark, str(tmp_path / "d"), ["selected_model"])["selected_model"] == "m"
    (tmp_path / "e.json").write_text(json.dumps({"x": 1}))
    with pytest.raises(readers.SourceError):
        readers.document(spark, str(tmp_path / "e.json"), ["selected_model"])
    with pytest.raises(readers.SourceError):
        readers.require_tables(spark, [str(tmp_path), str(tmp_path / "none")])
    with pytest.raises(readers.SourceError):
        sinks.exact_outputs(["a"], ["a", "b"])
