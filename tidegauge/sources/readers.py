"""Readers of daily trace files and of the artefacts between stages."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import day_of_file, fold
from tidegauge.sources.arrow_source import ArrowFiles


class SourceError(ValueError):
    """The files of a source are not what the source needs."""


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, name, length) of files under ``root``, found where Spark finds them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def discover(spark: SparkSession, root: str, csv_pattern: str, feather_pattern: str) -> tuple[str, list[str]]:
    """('csv' or 'feather', sorted paths): daily CSVs or exactly one Feather file; anything else raises."""
    def paths(pattern: str) -> list[str]:
        return sorted(r["path"] for r in list_files(spark, root, pattern).select("path").collect())  # a file a day

    csvs, feathers = paths(csv_pattern), paths(feather_pattern)
    if csvs and feathers:
        raise SourceError("both CSV and Feather files")
    if len(feathers) > 1:
        raise SourceError(f"{len(feathers)} Feather files")
    if not csvs and not feathers:
        raise SourceError(f"no files under {root}")
    names = [p.rsplit("/", 1)[-1] for p in csvs]
    if len(set(names)) < len(names):
        raise SourceError("a day occurs twice")
    return ("csv", csvs) if csvs else ("feather", feathers)


def day_files(pattern: str, days: int) -> list[str]:
    """Names of a source's daily files: the pattern's star is the day in two digits, from 01."""
    return [pattern.replace("*", f"{day:02d}") for day in range(1, days + 1)]


def file_report(spark: SparkSession, root: str, pattern: str, expected: list[str]) -> DataFrame:
    """(name, state) of files that are missing, unexpected or there more than once."""
    found = list_files(spark, root, pattern).groupBy("name").count()
    wanted = spark.createDataFrame([(n,) for n in expected], "name string").withColumn("wanted", F.lit(True))
    state = F.when(F.col("count").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("count") > 1, "duplicate")
    return found.join(wanted, "name", "full").select("name", state.alias("state")).where("state is not null")


def missing_columns(spark: SparkSession, path: str, required: list[str]) -> list[str]:
    """Required columns that the header of a CSV file lacks."""
    return sorted(set(required) - set(header(spark, path)))


def daily_csv(spark: SparkSession, paths: list[str], schema: str, columns: list[str]) -> DataFrame:
    """Projected scan of daily CSVs; the trace day comes from the file name."""
    rows = spark.read.schema(schema).option("header", True).csv(paths)
    return rows.select(*columns, day_of_file(F.col("_metadata.file_name")).alias("trace_day"))


def feather(spark: SparkSession, paths: list[str], schema: str, batches: int = 16) -> DataFrame:
    """Projected scan of Arrow files of any size: a task takes ``batches`` record batches, found by the footer, and only the schema's columns.

    Files are opened by Arrow's own file systems (local or mounted paths, hdfs, s3, gs), on the driver for the footers.
    """
    spark.dataSource.register(ArrowFiles)
    return spark.read.format("arrow_files").schema(schema).option("paths", json.dumps(paths)).option("batches", batches).load()


def daily_feather(spark: SparkSession, path: str, schema: str, day: str = "day", batches: int = 16) -> DataFrame:
    """The single file of a source that holds all days: its column ``day`` becomes the trace day, as the name of a daily file does."""
    rows = feather(spark, [path], f"{schema}, `{day}` bigint", batches)
    return rows.withColumnRenamed(day, "trace_day").withColumn("trace_day", F.col("trace_day").cast("int"))


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file, without a byte-order mark; an empty file raises."""
    first = spark.read.text(path).first()
    if first is None:
        raise SourceError(f"{path} is empty")
    return [c.strip().strip('"') for c in first[0].removeprefix("﻿").split(",")]


def trigger_sample(spark: SparkSession, path: str, rows: int = 10_000) -> DataFrame:
    """Labels of a file's first rows with their counts; blank ones as <blank>."""
    label = F.when(F.trim("Trigger") == "", "<blank>").otherwise(F.coalesce("Trigger", F.lit("<blank>")))
    return spark.read.option("header", True).csv(path).select(label.alias("Trigger")).limit(rows).groupBy("Trigger").count()


def trigger_report(spark: SparkSession, paths: list[str], allowed: list[str], rows: int = 10_000) -> DataFrame:
    """(path, n_rows, invalid, state) of every file's sample: pass, incompatible, empty, or no column; only ``pass`` is right.

    A sample is a file's first ``rows`` rows; there is a file a day.
    """
    headers = {p: spark.read.option("header", True).csv(p).columns for p in paths}
    sampled = [
        trigger_sample(spark, p, rows).select(F.lit(p).alias("path"), "Trigger", "count") for p, names in headers.items() if "Trigger" in names
    ]
    files = spark.createDataFrame([(p, "Trigger" in names or not names) for p, names in headers.items()], "path string, readable boolean")
    none = spark.createDataFrame([], "path string, Trigger string, count long")
    outside = F.when(~fold(F.col("Trigger")).isin(*allowed), F.col("Trigger"))
    found = reduce(DataFrame.unionAll, sampled, none).groupBy("path").agg(
        F.sum("count").alias("n_rows"), F.sort_array(F.collect_set(outside)).alias("invalid")
    )
    state = (
        F.when(~F.col("readable"), "no column")
        .when(F.col("n_rows") == 0, "empty")
        .when(F.size("invalid") > 0, "incompatible")
        .otherwise("pass")
    )
    return (
        files.join(found, "path", "left")
        .withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
        .withColumn("invalid", F.coalesce("invalid", F.array().cast("array<string>")))
        .select("path", "n_rows", "invalid", state.alias("state"))
    )


def require_triggers(report: DataFrame) -> None:
    """Raise with every file of a trigger report that does not pass."""
    bad = report.where("state != 'pass'").orderBy("path").collect()  # a file a day
    if bad:
        raise SourceError("; ".join(f"{r['path']}: {r['state']} {', '.join(r['invalid'])}".rstrip() for r in bad))


def split_rows(spark: SparkSession, path: str, name: str, upto: int | None = None) -> DataFrame:
    """One split of the model features; other splits are pruned or pushed down, not read."""
    rows = spark.read.parquet(path).where(F.col("split") == name)
    return rows if upto is None else rows.where(F.col("hour_index") <= upto)


def document(spark: SparkSession, path: str, required: list[str]) -> dict:
    """A JSON document of one object with all required fields."""
    row = spark.read.option("multiLine", True).json(path).first()
    found = row.asDict() if row else {}
    missing = [k for k in required if found.get(k) is None]
    if missing:
        raise SourceError(f"{path}: no {', '.join(missing)}")
    return found


def require_tables(spark: SparkSession, paths: list[str]) -> None:
    """Raise with all paths that cannot be listed."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    missing = [p for p in paths if not (q := fs.Path(p)).getFileSystem(conf).exists(q)]
    if missing:
        raise SourceError("missing: " + ", ".join(missing))
