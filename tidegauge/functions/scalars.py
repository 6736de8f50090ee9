"""Null-safe scalar expressions that the operators share. Missing values are nulls throughout, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(x: Column) -> Column:
    """Text without surrounding white space, in lower case."""
    return F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))


def slug(x: Column) -> Column:
    """Lower-case label with every run of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def day_of_file(name: Column) -> Column:
    """Trace day in a file name such as ``x.d07.csv``."""
    return F.regexp_extract(name, r"\.d(\d{1,2})\.csv$", 1).try_cast("int")


def tuple_label(*parts: Column) -> Column:
    return F.concat(F.lit("("), F.concat_ws(",", *(p.cast("string") for p in parts)), F.lit(")"))


def compact(x: Column) -> Column:
    """A number without trailing zeros."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def finite(x: Column) -> Column:
    """False for null, NaN and infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def number(x: Column) -> Column:
    """Lenient number: null for anything that is not a finite number."""
    value = x.try_cast("double")
    return F.when(finite(value), value)


def ratio(a: Column, b: Column) -> Column:
    """a / b where b is positive and finite, else null."""
    return F.when(finite(b) & (b > 0), a / b)


def non_negative(x: Column) -> Column:
    """The value clipped at 0; null stays null."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def null_share(x: Column) -> Column:
    """Aggregate: percentage of nulls, null over no rows."""
    return F.try_divide(F.lit(100.0) * F.count_if(x.isNull()), F.count("*"))


def hour_angle(hour: Column) -> Column:
    return F.lit(2.0) * F.pi() * hour / 24.0
