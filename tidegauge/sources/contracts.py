"""CSV files whose inferred column types must agree with declared families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.sources.readers import SourceError

#: family: (type to read, inferred types that agree without a look at the values)
FAMILIES = {
    "text": ("string", None),
    "whole": ("bigint", ("int", "bigint")),
    "decimal": ("double", ("int", "bigint", "double")),
    "flag": ("boolean", ("boolean",)),
}
CORRUPT = "_corrupt_record"
TEXTS = ("trigger", "model", "dataset_split", "selected_model", "feature", "aggregation_level")
WHOLES = ("hour_index", "trace_day", "hour_of_day", "forecast_hour")


def family(column: str) -> str:
    """The family of a published column, which its name decides."""
    name = column.lower()
    if name in TEXTS:
        return "text"
    if name in WHOLES or name.endswith("_rank"):
        return "whole"
    return "flag" if name.startswith(("is_", "meets_")) or name == "selected_on_validation" else "decimal"


def inferred_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns with the types that one pass over the values finds."""
    return spark.read.options(header=True, inferSchema=True).csv(path)


def typed_csv(spark: SparkSession, path: str, declared: dict[str, str], strict: bool = True) -> DataFrame:
    """All columns of a CSV file in the types of their declared families, and ``_corrupt_record``.

    The header must name the declared columns, in any order. One inference pass
    finds columns whose values may not fit; only their values are counted then.
    A value that does not fit raises if ``strict``; otherwise its row stays,
    with a null there and its text in ``_corrupt_record``. Empty values are
    nulls of any family; a file without rows gives none. As everywhere in
    Spark, a row is marked for the columns that a query reads.
    """
    found = inferred_csv(spark, path)
    if set(found.columns) != set(declared):
        raise SourceError(f"{path}: columns {sorted(set(found.columns) ^ set(declared))} are missing or not declared")
    doubtful = [c for c, t in found.dtypes if FAMILIES[declared[c]][1] is not None and t not in FAMILIES[declared[c]][1]]
    if doubtful and strict:
        texts = spark.read.schema(", ".join(f"`{c}` string" for c in found.columns)).option("header", True).csv(path)
        misfit = [F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(FAMILIES[declared[c]][0]).isNull()).alias(c) for c in doubtful]
        wrong = {c: n for c, n in texts.agg(*misfit).first().asDict().items() if n}
        if wrong:
            raise SourceError(f"{path}: " + ", ".join(f"{n} values of {c} are not {declared[c]}" for c, n in wrong.items()))
    schema = ", ".join(f"`{c}` {FAMILIES[declared[c]][0]}" for c in found.columns) + f", {CORRUPT} string"
    return spark.read.schema(schema).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).csv(path)


def wrong_types(frame: DataFrame, declared: dict[str, str] | None = None) -> list[str]:
    """Columns of a table whose type is not of their family, from the schema alone; families by name where none are declared."""
    def fits(column: str, kind: str) -> bool:
        want = (declared or {}).get(column) or family(column)
        if want == "text":
            return kind == "string"
        return kind in (*FAMILIES[want][1], *(("smallint", "tinyint") if want in ("whole", "decimal") else ())) or (want == "decimal" and kind.startswith(("float", "decimal")))

    return [c for c, t in frame.dtypes if not fits(c, t)]
