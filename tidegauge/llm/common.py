"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.sources.shared import heavy_keys, join_unique, materialize, shared_dir

__all__ = ["heavy_keys", "join_unique", "materialize", "shared_dir"]

#: Bytes that end a word: everything in ASCII but digits and letters. A-Z map to a-z.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Bound what one Arrow batch brings into a Python worker; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def id_text_row(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """(id, text), and with ``carry`` the whole row as one struct: it needs no join back, and no name can clash."""
    small_batches(docs)
    row = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if carry else []
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), *row)


def schema_of(source: DataFrame, ddl: str) -> T.StructType:
    """``ddl``, and the carried row where ``source`` has one."""
    return T.StructType([*T.StructType.fromDDL(ddl).fields, *(f for f in source.schema if f.name == "row")])


def normalised(text: str | None) -> bytes:
    """Lower-cased ASCII letters, digits and all bytes above ASCII; everything else a space."""
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables that never cut a group of equal ``key``, with the places where groups start and the end."""
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([held, now]) if held is not None else now
        keys = now.column(key).to_numpy()
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if not len(edges):
            held = now
            continue
        last = int(edges[-1])
        yield now.slice(0, last), np.concatenate([[0], edges])
        held = now.slice(last)
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])
