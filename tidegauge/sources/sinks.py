"""Writers of the artefacts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, DataFrameWriter

from tidegauge.sources.readers import SourceError, require_tables


def parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite; partitioned columns are pruned on reading."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def single_file(part: DataFrameWriter, kind: str, path: str) -> None:
    """Write the one part of a frame as the file ``path``: Spark commits it to a folder beside, a rename publishes it.

    What stood at ``path`` is replaced only after the new file is complete. A frame without a part raises.
    """
    folder, _, name = path.rstrip("/").rpartition("/")
    beside = f"{folder}/_{name}-{uuid.uuid4().hex}"
    part.format(kind).save(beside)
    spark = part._spark
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = at(beside).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = files.globStatus(at(f"{beside}/part-*"))
    try:
        if len(parts) != 1:
            raise SourceError(f"{path}: {len(parts)} parts, expected 1")
        files.delete(at(path), True)
        if not files.rename(parts[0].getPath(), at(path)):
            raise SourceError(f"{path}: could not be renamed to")
    finally:
        files.delete(at(beside), True)


def report_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """The file ``path`` with a header, in a full order; for report tables, which are small by definition."""
    single_file(df.coalesce(1).sortWithinPartitions(*order).write.option("header", True), "csv", path)


def json_document(row: DataFrame, path: str) -> None:
    """The file ``path`` with the single row of ``row`` as an indented JSON object."""
    single_file(row.limit(1).coalesce(1).write.option("pretty", True), "json", path)


def require_parent(df: DataFrame, path: str) -> None:
    """The output folder must exist before anything is written."""
    require_tables(df.sparkSession, [path])


def exact_outputs(written: list[str], expected: list[str]) -> None:
    if set(written) != set(expected) or len(written) != len(expected):
        raise SourceError(f"wrote {sorted(written)}, expected {sorted(expected)}")
