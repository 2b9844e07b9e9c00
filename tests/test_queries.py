"""Every registered query against its SQL, and the driver contract."""

import importlib
from datetime import datetime

import pytest

from workload import queries as workload_queries
from workload.compare import connect, differences
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, SF_DIR), duck, ORACLE[name]) == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) >= set(ORACLE)


def test_landing_shuffles_whole_rows_once(spark, tmp_path, monkeypatch):
    day = datetime(1996, 5, 1)
    lines = [(k, 1, 1, n, 9.0, 5.0, 0.05, 0.01, "N", "O", day.replace(year=1995 + k % 3)) for k in range(6) for n in (1, 2)]
    names = ["orderkey", "partkey", "suppkey", "linenumber", "quantity", "extendedprice", "discount", "tax", "returnflag", "linestatus", "shipdate"]
    spark.createDataFrame(lines, [f"l_{n}" for n in names]).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(k, 7, "1-URGENT") for k in range(6)]
    spark.createDataFrame(orders, ["o_orderkey", "o_custkey", "o_orderpriority"]).write.parquet(f"{tmp_path}/orders.parquet")
    hints = []
    frame = type(spark.range(1))
    hint = frame.hint
    monkeypatch.setattr(frame, "hint", lambda self, name, *more: hints.append(name) or hint(self, name, *more))
    settings = workload_queries._landed(spark, str(tmp_path))
    assert "rebalance" not in hints
    landed = spark.table(settings.table("bronze", "transactions_bz"))
    assert {r[0]: r[1] for r in landed.groupBy("batch_id").count().collect()} == {0: 4, 1: 4, 2: 4}
