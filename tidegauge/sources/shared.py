"""Intermediate tables in the folder that driver and executors share, and joins on keys that a few values dominate."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A join key is heavy above this share of the rows, so there are fewer than ``1 / HEAVY_SHARE`` heavy keys.
HEAVY_SHARE = 0.001
LEAST_HEAVY = 200


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own if all tasks run in this process, else an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = f"file://{tempfile.mkdtemp(prefix='tidegauge-')}"
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps neither recompute it nor depend on an executor.

    The table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidegauge/{label}-{uuid.uuid4().hex}"
    _write(df, path)
    return spark.read.schema(df.schema).parquet(path)


def _write(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").parquet(path)
    delete_on_exit(df.sparkSession, path)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)


#: Stored tables of this driver: what was asked of which files, and where the result lies.
_STORED: dict[tuple, tuple[str, str]] = {}


def source_state(spark: SparkSession, path: str) -> tuple:
    """(file, length, modification time) of a file, or of all files below a folder; a new or changed file changes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    found = []
    while files.hasNext():
        one = files.next()
        found.append((one.getPath().toString(), one.getLen(), one.getModificationTime()))
    return tuple(sorted(found))


def stored(spark: SparkSession, label: str, sources: list[str], build) -> DataFrame:
    """The table that ``build()`` plans, computed once for these source files as they are now and read from the shared folder after that."""

    def write(path: str) -> str:
        df = build()
        _write(df, path)
        return df.schema.json()

    path, schema = _kept(spark, label, sources, write)
    return spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(path)


def stored_path(spark: SparkSession, label: str, sources: list[str], write) -> str:
    """The path that ``write(path)`` has filled, once for these source files as they are now."""
    return _kept(spark, label, sources, write)[0]


def _kept(spark: SparkSession, label: str, sources: list[str], write) -> tuple[str, str]:
    key = (spark.sparkContext.applicationId, label, *(source_state(spark, p) for p in sources))
    if key not in _STORED:
        path = f"{shared_dir(spark)}/tidegauge/{label}-{uuid.uuid4().hex}"
        _STORED[key] = (path, write(path))
        delete_on_exit(spark, path)
    return _STORED[key]


def release(spark: SparkSession) -> int:
    """Delete the tables that ``stored`` has kept for this application; how many there were. Plans that read them must have run."""
    mine = [k for k in _STORED if k[0] == spark.sparkContext.applicationId]
    for key in mine:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_STORED.pop(key)[0])
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(mine)


def heavy_keys(counts: DataFrame, key: str, rows: int) -> list:
    """Keys of a (key, count) table with more than ``HEAVY_SHARE`` of the rows: fewer than 1,000."""
    least = max(LEAST_HEAVY, int(rows * HEAVY_SHARE))
    return [r[0] for r in counts.where(F.col(key).isNotNull() & (F.col("count") > least)).select(key).collect()]


def join_unique(rows: DataFrame, unique: DataFrame, key: str, how: str = "inner", heavy: list | None = None) -> DataFrame:
    """``rows`` joined with a table of one row a key; rows of heavy keys do not meet in one task.

    ``how`` is inner or left. ``heavy`` keys, fewer than 1,000, are joined by
    broadcast; all others by Spark's choice. Where they are not given, they are
    counted; ``rows`` should be a stored table then.
    """
    known = heavy_keys(rows.groupBy(key).count(), key, rows.count()) if heavy is None else heavy
    if not known:
        return rows.join(unique, key, how)
    mark = F.coalesce(F.col(key).isin(*known), F.lit(False))
    few = F.broadcast(unique.where(F.col(key).isin(*known)))
    return rows.where(~mark).join(unique, key, how).unionByName(rows.where(mark).join(few, key, how))
