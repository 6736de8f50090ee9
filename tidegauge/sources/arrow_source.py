"""Arrow IPC files (Feather version 2) as a data source whose partitions are runs of record batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def _open(path: str):
    """A random-access file: only what is asked for is read."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


class BatchRun(InputPartition):
    """Record batches ``first`` to ``last`` (exclusive) of one file."""

    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class ArrowReader(DataSourceReader):
    def __init__(self, paths: list[str], batches: int, schema: StructType):
        self.paths, self.batches, self.schema = paths, batches, schema

    def partitions(self) -> list[BatchRun]:
        """From the footers alone, which hold the place of every batch."""
        runs = []
        for path in self.paths:
            with _open(path) as source, pa.ipc.open_file(source) as file:
                n = file.num_record_batches
            runs += [BatchRun(path, k, min(k + self.batches, n)) for k in range(0, n, self.batches)]
        return runs

    def read(self, partition: BatchRun | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there are no partitions
            return
        want = to_arrow_schema(self.schema)
        with _open(partition.path) as source:
            with pa.ipc.open_file(source) as file:
                places = sorted(file.schema.get_field_index(c) for c in want.names)
            if places and places[0] < 0:
                raise ValueError(f"{partition.path}: no {', '.join(c for c in want.names if file.schema.get_field_index(c) < 0)}")
            with pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=places)) as file:
                for k in range(partition.first, partition.last):
                    rows = pa.Table.from_batches([file.get_batch(k)]).select(want.names)
                    yield from rows.cast(want).to_batches()


class ArrowFiles(DataSource):
    """Options: ``paths`` (a JSON list) and ``batches`` (record batches a task, 16 by default). The declared schema is the projection."""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def reader(self, schema: StructType) -> ArrowReader:
        return ArrowReader(json.loads(self.options["paths"]), int(self.options.get("batches", 16)), schema)
