"""Joins whose conditions are checked inside the plan: nothing runs until the result is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matched(left: DataFrame, right: DataFrame, keys: list[str], name: str = "join") -> DataFrame:
    """The rows of two frames that hold the same keys, each once; a repeated, missing or null key raises when the row is made.

    Keys are counted before they meet, so a repeated key costs one row, and the
    check and the join share their two shuffles.
    """

    def keyed(frame: DataFrame, side: str) -> DataFrame:
        rest = F.struct(*(frame[c] for c in frame.columns if c not in keys))
        return frame.groupBy(*keys).agg(F.count("*").alias(f"_{side}_n"), F.first(rest).alias(f"_{side}"))

    both = keyed(left, "l").join(keyed(right, "r"), keys, "full")
    once = F.coalesce((F.col("_l_n") == 1) & (F.col("_r_n") == 1), F.lit(False))
    place = F.concat(F.lit(f"{name}: not one to one at "), F.to_json(F.struct(*keys)))
    row = F.when(once, F.struct("_l", "_r")).otherwise(F.raise_error(place))
    both = both.select(*keys, row.alias("_row"))
    named = [F.col(f"_row._l.{c}").alias(c) for c in left.columns if c not in keys]
    return both.select(*keys, *named, *(F.col(f"_row._r.{c}").alias(c) for c in right.columns if c not in keys))


def found(rows: DataFrame, lookup: DataFrame, keys: list[str], value: str, name: str = "lookup") -> DataFrame:
    """``rows`` with ``value`` of the lookup table; a row whose key has none raises when it is made."""
    place = F.concat(F.lit(f"{name}: no {value} for "), F.to_json(F.struct(*keys)))
    there = F.when(F.col(value).isNull(), F.raise_error(place)).otherwise(F.col(value))
    return rows.join(lookup.select(*keys, value), keys, "left").withColumn(value, there)
