import importlib

import duckdb
import pytest

import __spark_entry__ as contract
from tidegauge.catalog import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 2e-6)
    return a == b


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize(
    "name",
    [
        "hourly_demand_by_trigger", "hourly_total_demand", "data_quality_summary", "minute_to_hour_reshape", "model_features", "baseline_metrics",
        "model_ranking", "forecast_intervals", "capacity_recommendation", "bi_forecast_vs_actual", "demand_reconciliation", "constraint_report",
        "bi_table_violations",
    ],
)
def test_query_equals_sql(spark, data, duck, name):
    rows = QUERIES[name](spark, data)
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(rows.columns) == sorted(names)
    key = lambda r: tuple(str(x) for x in r if not isinstance(x, float))
    want, found = sorted(cursor.fetchall(), key=key), sorted(map(tuple, rows.select(*names).collect()), key=key)
    assert len(want) == len(found)
    assert all(same(x, y) for a, b in zip(found, want) for x, y in zip(a, b))


def test_registry_is_consistent():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(ORACLE) <= set(QUERIES)


def test_entry_stands_without_the_corpus_subpackage(monkeypatch):
    real = importlib.import_module

    def missing(name, *args):
        if name.startswith(("tidegauge.llm", "corpus_pipeline")):
            raise ImportError(name)
        return real(name, *args)

    monkeypatch.setattr(contract, "import_module", missing)
    assert set(contract.queries()) == set(QUERIES)


def test_stream_equals_batch(spark, data):
    found = QUERIES["streaming_hourly_demand"](spark, data)
    want = spark.read.parquet(f"{data}/events.parquet").selectExpr("date_format(date_trunc('HOUR', ts), 'yyyy-MM-dd HH:mm:ss') AS hour", "event_type")
    want = want.groupBy("hour", "event_type").count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
