"""Files to bronze to silver to gold, over two rounds and under retries."""

import json
import os
import shutil
import subprocess
import sys
from datetime import date, datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from varve import schemas
from varve.errors import CheckpointLost, CursorMissing, DatabaseMissing, NotNullViolated, TableLost
from varve.operators.changes import read_changes, read_changes_after
from varve.operators.merge import upsert
from varve.plans import marts, pipeline
from varve.plans.marts import customer_stats, product_sales, sales_summary
from varve.sources import cursors, tables
from varve.sources.tables import BATCH, Settings, version_in
from varve.sources.feeds import CUSTOMERS, PRODUCTS, TRANSACTIONS, read_feed, stream_feed
from varve.streaming.ingest import ingest, land_batch

AS_OF = date(2024, 6, 30)


def _put(settings, feed, name, text):
    folder = settings.landing_path(feed)
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write(text)


HEADER = "customer_id,name,email,country,customer_type,registration_date,age,gender,total_purchases\n"


def customers(settings, name, *lines):
    _put(settings, "customers", name, HEADER + "".join(f"{line}\n" for line in lines))


def products(settings, name, *items):
    _put(settings, "products", name, json.dumps([
        dict(zip(("product_id", "name", "price", "rating", "stock_quantity"), i), brand="b", category="c")
        for i in items
    ], indent=1))


FIELDS = ("transaction_id", "customer_id", "product_id", "quantity", "total_amount",
          "transaction_date", "payment_method", "store_type")


def transactions(settings, name, *items, extra=""):
    text = "".join(json.dumps(dict(zip(FIELDS, i))) + "\n" for i in items)
    _put(settings, "transactions", name, text + extra)


def first_round(s):
    customers(
        s, "c1.csv",
        "1,Ann,ann@x,NL,new,2024-01-01,18,f,10001",
        "2,Bob, NULL ,NL,new,2024-01-01,30,m,5",
        "3,Cid,cid@x,NL,new,2024-01-01,17,m,5",
        "4,Dee,dee@x,NL,new,2024-01-01,100,f,5000",
        "x5,Eve,eve@x,NL,new,bad,40,f,-1",
    )
    products(s, "p1.json", (1, "pen", 5.0, 4.0, "7"), (2, "ink", -3.0, 6.0, "-3"))
    transactions(
        s, "t1.json",
        ("a", 1, 1, 2, 10.0, "2024-02-01", "card", "web"),
        ("b", 1, 2, 1, 5.5, "2024-02-01", "card", "web"),
        ("c", 4, 1, -2, 7.0, "2024-02-03", "cash", "web"),
        ("d", 4, 1, 1, 20.0, "2024-03-03", None, "web"),
        ("e", 9, 1, 1, 30.0, "2024-02-01", "card", "web"),
        ("f", 1, 1, 1, 30.0, "null", "card", "web"),
        ("g", 1, 1, 1, 30.0, "2024-13-40", "card", "web"),
        ("a", 1, 1, 2, 10.0, "2024-02-01", "card", "web"),
        extra="{broken\n",
    )


def second_round(s):
    customers(s, "c2.csv", "1,Anna,ann@x,BE,new,2024-01-01,19,f,5001", "9,Fay,fay@x,NL,new,2024-01-01,50,f,0")
    products(s, "p2.json", (1, "pen", 6.0, 4.0, "7"), (2, "ink", -3.0, 6.0, "-3"), (3, "cap", 2.0, 3.0, "50"))
    transactions(
        s, "t2.json",
        ("a", 1, 1, 2, 10.0, "2024-02-01", "card", "web"),
        ("h", 1, 1, 1, 4.5, "2024-02-01", "card", "web"),
        ("i", 1, 3, 1, 9.99, "2024-04-01", None, "web"),
        ("j", 4, 1, 3, 1.0, "2024-03-03", None, "web"),
    )


def run_all(spark, s):
    pipeline.run_bronze(spark, s)
    pipeline.run_silver(spark, s, AS_OF)
    return pipeline.run_gold(spark, s, AS_OF)


@pytest.fixture(scope="module")
def two_rounds(spark, tmp_path_factory):
    """Shared by the tests that leave the tables as they are."""
    s = tables.Settings(root=str(tmp_path_factory.mktemp("two_rounds")), env="two_rounds")
    pipeline.run_setup(spark, s)
    first_round(s)
    lost = [run_all(spark, s)]
    second_round(s)
    lost.append(run_all(spark, s))
    return s, lost


def table(spark, s, layer, name):
    return spark.table(s.table(layer, name))


def test_two_rounds(spark, two_rounds, rows):
    s, lost = two_rounds
    si = table(spark, s, "silver", "customers_si")
    assert rows(si, "customer_id", "name", "customer_segment", "days_since_registration") == [
        (1, "Anna", "Medium Value", 181), (4, "Dee", "Low Value", 181), (9, "Fay", "Low Value", 181),
    ]
    changes = table(spark, s, "silver", "customers_si_changes")
    assert rows(changes.filter("_commit_version = 1"), "_change_type", "name") == [
        ("insert", "Fay"), ("update_postimage", "Anna"), ("update_preimage", "Ann"),
    ]

    history = table(spark, s, "silver", "products_si")
    assert rows(history, "product_id", "price", "rating", "stock_quantity", "stock_status", "is_active") == [
        (1, 5.0, 4.0, "7", "Low Stock", False),
        (1, 6.0, 4.0, "7", "Low Stock", True),
        (2, 0.0, 5.0, "0", "Out of Stock", True),
        (3, 2.0, 3.0, "50", "Sufficient Stock", True),
    ]
    spans = history.filter("product_id = 1").orderBy("start_date").collect()
    assert spans[0].end_date == spans[1].start_date and spans[1].end_date is None

    facts = table(spark, s, "silver", "transactions_si")
    assert rows(facts, "transaction_id", "order_status", "_commit_version") == [
        ("a", "Completed", 0), ("b", "Completed", 0), ("c", "Cancelled", 0), ("d", "Completed", 0),
        ("e", "Completed", 0), ("h", "Completed", 1), ("i", "Completed", 1), ("j", "Completed", 1),
    ]

    sales = table(spark, s, "gold", "sales_summary_gd")
    assert rows(sales, "transaction_date", "payment_method", "total_sales", "total_transactions",
                "avg_order_value", "total_quantity_sold") == [
        (date(2024, 2, 1), "card", 50.0, 4, 12.5, 5),
        (date(2024, 3, 3), None, 21.0, 2, 10.5, 4),
        (date(2024, 4, 1), None, 9.99, 1, 9.99, 1),
    ]

    stats = table(spark, s, "gold", "customers_stats_gd")
    assert rows(stats, "customer_id", "name", "first_order_date", "last_order_date",
                "distinct_transaction_dates", "total_transactions", "total_spent",
                "avg_order_value", "recency_days") == [
        (1, "Anna", date(2024, 2, 1), date(2024, 4, 1), 2, 4, 29.99, 7.5, 90),
        (4, "Dee", date(2024, 3, 3), date(2024, 3, 3), 1, 2, 21.0, 10.5, 119),
    ]
    # Customer 9 arrived after the sale: the sale stays out and is reported.
    assert lost[0]["customers_stats_gd"] == {0: 1}
    assert lost[1]["customers_stats_gd"] == {1: 0}
    assert lost[0]["product_sales_summary_gd"] == {0: 0}

    by_product = table(spark, s, "gold", "product_sales_summary_gd")
    assert rows(by_product, "product_id", "transaction_date", "total_quantity_sold",
                "total_revenue", "num_transactions") == [
        (1, date(2024, 2, 1), 4, 44.5, 3),
        (1, date(2024, 2, 3), 0, 7.0, 1),
        (1, date(2024, 3, 3), 4, 21.0, 2),
        (2, date(2024, 2, 1), 1, 5.5, 1),
        (3, date(2024, 4, 1), 1, 9.99, 1),
    ]
    # A month the batch does not touch keeps its directory.
    versions = tables.partition_versions(
        spark, s.table("gold", "product_sales_state"), "transaction_month",
        ["2024-02", "2024-03", "2024-04"],
    )
    assert versions == {"2024-02": 1, "2024-03": 1, "2024-04": 1}


def test_rerun_without_new_files_changes_nothing(spark, two_rounds, rows):
    s, _ = two_rounds
    names = [("silver", n) for n in ("customers_si", "products_si", "transactions_si")]
    names += [("gold", n) for n in pipeline.GOLD]
    before = {n: rows(table(spark, s, *n)) for n in names}
    assert run_all(spark, s)["sales_summary_gd"] == {}
    assert {n: rows(table(spark, s, *n)) for n in names} == before


def test_reapplying_every_batch_changes_nothing(spark, two_rounds, rows):
    """As after a crash that lost the cursors but not the published tables."""
    s, _ = two_rounds
    names = [("silver", n) for n in ("customers_si", "products_si", "transactions_si")]
    names += [("gold", n) for n in pipeline.GOLD]
    before = {n: rows(table(spark, s, *n)) for n in names}
    for name in [*pipeline.SILVER, *pipeline.GOLD]:
        cursors.write_cursor(spark, s.table("silver", "meta_si"), name, -1)
    pipeline.run_silver(spark, s, AS_OF)
    pipeline.run_gold(spark, s, AS_OF)
    assert {n: rows(table(spark, s, *n)) for n in names} == before


def test_crash_between_partition_swaps(spark, settings, rows, monkeypatch):
    """The first month is swapped, the run dies, the retry finishes the rest once."""
    s = settings
    pipeline.run_setup(spark, s)
    first_round(s)
    pipeline.run_bronze(spark, s)
    pipeline.run_silver(spark, s, AS_OF)

    real, calls = tables.path_exists, []

    def dies_on_second(session, path):
        calls.append(path)
        if len(calls) == 2:
            raise OSError("lost the driver")
        return real(session, path)

    monkeypatch.setattr(tables, "path_exists", dies_on_second)
    with pytest.raises(OSError):
        pipeline.update_product_sales(spark, s)
    monkeypatch.setattr(tables, "path_exists", real)
    mart = s.table("gold", "product_sales_summary_gd")
    state = s.table("gold", "product_sales_state")
    assert tables.partition_values(spark, state, "transaction_month") == ["2024-02"]
    pipeline.update_product_sales(spark, s)
    expected = product_sales(
        spark.table(s.table("silver", "transactions_si")),
        spark.table(s.table("silver", "products_si")).filter("is_active"),
    )
    cols = ["product_id", "transaction_date", "total_quantity_sold", "total_revenue", "num_transactions"]
    assert rows(spark.table(mart), *cols) == rows(expected, *cols)


def test_crash_before_snapshot_swap(spark, settings, rows, monkeypatch):
    """Changes and helper rows of a failed try are overwritten, not added to."""
    s = settings
    pipeline.run_setup(spark, s)
    first_round(s)
    pipeline.run_bronze(spark, s)

    def dies(*args, **kwargs):
        raise OSError("lost the driver")

    for step in (pipeline.load_customers, pipeline.load_products):
        with monkeypatch.context() as m:
            m.setattr(pipeline, "publish_snapshot", dies)
            with pytest.raises(OSError):
                step(spark, s)
        step(spark, s)
    assert table(spark, s, "silver", "customers_si_changes").count() == 2
    assert table(spark, s, "silver", "products_si").count() == 2

    pipeline.load_transactions(spark, s)
    with monkeypatch.context() as m:
        m.setattr(pipeline, "publish_snapshot", dies)
        with pytest.raises(OSError):
            pipeline.update_customer_stats(spark, s)
    pipeline.update_customer_stats(spark, s)
    stats = table(spark, s, "gold", "customers_stats_gd")
    assert rows(stats, "customer_id", "distinct_transaction_dates") == [(1, 1), (4, 1)]


def test_many_batches_equal_one(spark, tmp_path, rows):
    """With fixed dimensions, splitting the facts into batches does not change the marts."""
    facts = [
        (f"t{i}", 1 + i % 3, 1 + i % 2, i % 4, round(0.37 * i, 2), f"2024-0{1 + i % 3}-1{i % 5}",
         ["card", None][i % 2], "web")
        for i in range(60)
    ]
    results = []
    for tag, size in (("one", 60), ("many", 20)):
        s = tables.Settings(root=str(tmp_path / tag), env=f"split_{tag}")
        pipeline.run_setup(spark, s)
        customers(s, "c.csv", *[f"{i},n{i},m{i},NL,new,2024-01-01,30,f,1" for i in (1, 2, 3)])
        products(s, "p.json", (1, "pen", 5.0, 4.0, "7"), (2, "ink", 3.0, 3.0, "3"))
        for n, start in enumerate(range(0, 60, size)):
            transactions(s, f"t{n}.json", *facts[start:start + size])
            run_all(spark, s)
        results.append([
            rows(table(spark, s, "gold", g).drop("last_updated")) for g in pipeline.GOLD
        ])
    assert results[0] == results[1]
    tx = table(spark, s, "silver", "transactions_si")
    one_shot = [
        customer_stats(tx, table(spark, s, "silver", "customers_si"), AS_OF),
        sales_summary(tx),
        product_sales(tx, table(spark, s, "silver", "products_si").filter("is_active")),
    ]
    assert [rows(d.drop("last_updated")) for d in one_shot[:2]] == results[0][:2]
    assert rows(one_shot[2].drop("last_updated")) == rows(
        table(spark, s, "gold", "product_sales_summary_gd").drop("last_updated", "transaction_month")
    )


def test_read_changes_of_facts(spark, two_rounds, rows):
    s, _ = two_rounds
    changes = read_changes(spark, s.table("silver", "transactions_si"), 0)
    assert rows(changes, "transaction_id", "_change_type") == [("h", "insert"), ("i", "insert"), ("j", "insert")]
    plan = changes._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_commit_version" in plan.split("PartitionFilters")[1]


def test_archive_moves_files_one_batch_later(spark, settings):
    s = settings
    pipeline.run_setup(spark, s)
    customers(s, "c1.csv", "1,Ann,ann@x,NL,new,2024-01-01,18,f,1")
    ingest(spark, CUSTOMERS, s)
    assert os.listdir(s.landing_path("customers")) == ["c1.csv"]
    customers(s, "c2.csv", "2,Bob,bob@x,NL,new,2024-01-01,18,f,1")
    ingest(spark, CUSTOMERS, s)
    archived = [f for _, _, files in os.walk(s.archive_path("customers")) for f in files if f.endswith(".csv")]
    assert archived == ["c1.csv"]
    bronze = spark.table(s.table("bronze", "customers_bz"))
    assert sorted((r.customer_id, r.batch_id) for r in bronze.collect()) == [(1, 0), (2, 1)]


def test_lost_checkpoint_is_refused(spark, settings, monkeypatch):
    s = settings
    pipeline.run_setup(spark, s)
    customers(s, "c1.csv", "1,Ann,ann@x,NL,new,2024-01-01,18,f,1")
    ingest(spark, CUSTOMERS, s)
    os.rename(s.checkpoint_path("customers"), s.checkpoint_path("customers") + "_gone")
    with pytest.raises(CheckpointLost):
        ingest(spark, CUSTOMERS, s)


def test_small_batches_by_file_count(spark, settings):
    s = settings
    pipeline.run_setup(spark, s)
    for i in range(3):
        customers(s, f"c{i}.csv", f"{i},Ann,ann@x,NL,new,2024-01-01,18,f,1")
    ingest(spark, CUSTOMERS, s, max_files=1)
    assert tables.partition_values(spark, s.table("bronze", "customers_bz"), "batch_id") == ["0", "1", "2"]
    assert pipeline.load_customers(spark, s) == [0, 1, 2]


def test_batch_ingest(spark, settings, rows):
    s = settings
    pipeline.run_setup(spark, s)
    products(s, "p1.json", (1, "pen", 5.0, 4.0, "7"))
    ingest(spark, PRODUCTS, s, stream=False)
    ingest(spark, PRODUCTS, s, stream=False)
    assert rows(spark.table(s.table("bronze", "products_bz")), "product_id", "batch_id") == [(1, 0), (1, 1)]


def test_dirty_cells_become_null(spark, settings, rows):
    s = settings
    customers(s, "c.csv", "x,Ann,null,NL,new,never,old,f,1")
    assert rows(read_feed(spark, CUSTOMERS, s.landing_path("customers")),
                "customer_id", "name", "email", "registration_date", "age") == [(None, "Ann", "null", None, None)]
    transactions(s, "t.json", ("a", 1, 1, 1, 1.0, "2024-01-01", "card", "web"), extra="{broken\n")
    assert rows(read_feed(spark, TRANSACTIONS, s.landing_path("transactions")), "transaction_id") == [("a",), (None,)]


def test_all_invalid_batch_advances_the_cursor(spark, settings):
    s = settings
    pipeline.run_setup(spark, s)
    transactions(s, "t.json", ("a", None, 1, 1, 1.0, "2024-01-01", "card", "web"))
    ingest(spark, TRANSACTIONS, s)
    assert pipeline.load_transactions(spark, s) == [0]
    assert pipeline.load_transactions(spark, s) == []
    assert pipeline.update_sales_summary(spark, s) == {}
    assert cursors.read_cursor(spark, s.table("silver", "meta_si"), "sales_summary_gd") == 0


def test_setup_twice_keeps_data(spark, two_rounds):
    s, _ = two_rounds
    before = table(spark, s, "gold", "sales_summary_gd").count()
    pipeline.run_setup(spark, s)
    assert table(spark, s, "gold", "sales_summary_gd").count() == before
    assert cursors.read_cursor(spark, s.table("silver", "meta_si"), "products_si") == 1


def test_missing_database_and_cursor(spark, settings, tmp_path):
    with pytest.raises(DatabaseMissing):
        tables.create_snapshot_table(spark, "nowhere.t", "a INT", str(tmp_path))
    pipeline.run_setup(spark, settings)
    meta = settings.table("silver", "meta_si")
    with pytest.raises(CursorMissing):
        cursors.read_cursor(spark, meta, "unknown")
    assert cursors.read_cursor(spark, meta, "unknown", default=-1) == -1


def test_two_snapshots_stay_on_disk(spark, settings):
    s = settings
    pipeline.run_setup(spark, s)
    for i in range(4):
        customers(s, f"c{i}.csv", f"{i},Ann,ann@x,NL,new,2024-01-01,18,f,1")
        ingest(spark, CUSTOMERS, s)
        pipeline.load_customers(spark, s)
    assert table(spark, s, "silver", "customers_si").count() == 4
    base = f"{s.layer_path('silver')}/customers_si"
    kept = [f"{v}/{k}" for v in os.listdir(base) if v.startswith("v") for k in os.listdir(f"{base}/{v}") if k.startswith("slice=")]
    touched = {}
    for i in range(4):
        [k] = tables.touched_slices(spark, s.table("silver", "customers_si_slices"), spark.createDataFrame([(i,)], "customer_id INT"))
        touched.setdefault(k, []).append(i)
    assert sorted(kept) == sorted(f"v{v}/slice={k}" for k, versions in touched.items() for v in versions[-2:])


def test_merging_does_not_shuffle_the_stored_side(spark, two_rounds):
    s, _ = two_rounds
    current = table(spark, s, "silver", "customers_si")
    batch = spark.createDataFrame([(1, "x")], "customer_id INT, name STRING")
    merged = upsert(current, batch, ["customer_id"], check_unique=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (merged.rows, merged.changes):
            text = df._jdf.queryExecution().executedPlan().toString()
            assert text.count("Exchange") == 1 and "Bucketed: true" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    files = table(spark, s, "silver", "customers_si").inputFiles()
    assert 0 < len(files) <= 4


def _slices(spark, s, name):
    """Live folder and file names of every slice."""
    found = {}
    for path in spark.table(s.table("silver", name)).inputFiles():
        folder, file = path.rsplit("/", 1)
        found.setdefault(int(folder.rsplit("=", 1)[1]), set()).add((folder, file))
    return found


def test_untouched_slices_keep_their_files(spark, tmp_path, rows):
    """A batch reads and rewrites the slices of its keys only, of customers and of products."""
    s = Settings(root=str(tmp_path), env="slices", buckets=8)
    pipeline.run_setup(spark, s)
    customers(s, "c1.csv", *[f"{i},Ann,ann@x,NL,new,2024-01-01,18,f,1" for i in range(200)])
    products(s, "p1.json", *[(i, "x", 5.0, 3.0, "10") for i in range(200)])
    pipeline.run_bronze(spark, s, ("customers", "products"))
    for step in (pipeline.load_customers, pipeline.load_products):
        step(spark, s)
    names = ("customers_si_slices", "products_si_slices")
    before = {n: _slices(spark, s, n) for n in names}
    for n in names:
        assert sorted(before[n]) == list(range(8)) and all(len(files) == 1 for files in before[n].values())
        # A slice's files are those of its bucket.
        assert all(f"_{k:05d}." in file for k, files in before[n].items() for _, file in files)
    customers(s, "c2.csv", "7,Bob,bob@x,NL,new,2024-01-01,18,m,1", "1000,New,new@x,NL,new,2024-01-01,18,m,1")
    products(s, "p2.json", (7, "x", 6.0, 3.0, "10"), (8, "x", 5.0, 3.0, "10"))
    pipeline.run_bronze(spark, s, ("customers", "products"))
    for step in (pipeline.load_customers, pipeline.load_products):
        step(spark, s)
    for n, key, kind, changed in zip(names, ("customer_id", "product_id"), ("INT", "BIGINT"), ([7, 1000], [7])):
        touched = tables.touched_slices(spark, s.table("silver", n), spark.createDataFrame([(k,) for k in changed], f"{key} {kind}"))
        after = _slices(spark, s, n)
        assert {k for k in after if after[k] != before[n][k]} == set(touched) != set(after)
    assert rows(table(spark, s, "silver", "customers_si").filter("customer_id IN (6, 7, 1000)"), "customer_id", "name") == [
        (1000, "New"), (6, "Ann"), (7, "Bob"),
    ]
    assert table(spark, s, "silver", "customers_si").count() == 201
    history = table(spark, s, "silver", "products_si")
    assert history.count() == 201
    assert rows(history.filter("product_id = 7"), "price", "is_active") == [(5.0, False), (6.0, True)]


@pytest.mark.parametrize("dies_at", ["ALTER", "_published_"])
def test_crash_between_slices(spark, tmp_path, rows, monkeypatch, dies_at):
    """Some slices are moved, the run dies: the retry ends what was begun, from the changes that stand."""
    s = Settings(root=str(tmp_path), env=f"cut_{dies_at.strip('_').lower()}", buckets=4)
    pipeline.run_setup(spark, s)
    products(s, "p1.json", *[(i, "x", 5.0, 3.0, "10") for i in range(40)])
    pipeline.run_bronze(spark, s, ["products"])
    pipeline.load_products(spark, s)
    products(s, "p2.json", *[(i, "x", 6.0, 3.0, "10") for i in range(40)])
    pipeline.run_bronze(spark, s, ["products"])
    real_sql, real_touch, seen = spark.sql, tables._touch, []

    def sql(text, *args, **kwargs):
        if "SET LOCATION" in text and "slice" in text:
            seen.append(text)
            if dies_at == "ALTER" and len(seen) == 3:
                raise OSError("lost the driver")
        return real_sql(text, *args, **kwargs)

    def touch(session, path):
        if dies_at in path:
            raise OSError("lost the driver")
        return real_touch(session, path)

    with monkeypatch.context() as m:
        m.setattr(spark, "sql", sql)
        m.setattr(tables, "_touch", touch)
        with pytest.raises(OSError):
            pipeline.load_products(spark, s)
    assert len(seen) >= 3
    # Readers of the history do not see closed rows before all slices are in place.
    assert table(spark, s, "silver", "products_si").count() == 40
    pipeline.load_products(spark, s)
    history = table(spark, s, "silver", "products_si")
    assert rows(history.groupBy("price", "is_active").count()) == [(5.0, False, 40), (6.0, True, 40)]
    assert table(spark, s, "silver", "products_si_changes").count() == 160


def _ranges(files, column):
    """(file, least, greatest) of every row group."""
    found = []
    for path in files:
        meta = pq.read_metadata(path.removeprefix("file://").removeprefix("file:"))
        number = next(i for i in range(meta.num_columns) if meta.schema.column(i).name == column)
        for group in range(meta.num_row_groups):
            stats = meta.row_group(group).column(number).statistics
            found.append((path, stats.min, stats.max))
    return found


def test_bronze_and_facts_are_laid_out_by_key_and_time(spark, settings, rows):
    """Of row groups, a key reads one a batch, a time range those of its batches; a hot key is cut."""
    s = settings
    pipeline.run_setup(spark, s)
    bronze = s.table("bronze", "customers_bz")
    columns = spark.table(bronze).drop("batch_id").schema
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for batch_id in range(2):
            batch = spark.range(3000).select(
                ((F.col("id") * 7919) % 1000).cast("int").alias("customer_id"),
                F.lit(datetime(2024, 1, 1 + batch_id)).alias("inserted_time"),
                *[F.lit(None).cast(f.dataType).alias(f.name) for f in columns if f.name not in ("customer_id", "inserted_time", "age")],
                F.col("id").cast("int").alias("age"),
            )
            if batch_id == 1:
                hot = (F.col("age") % 3 == 0)
                batch = batch.withColumn("customer_id", F.when(hot, 500).otherwise(F.col("customer_id")))
            land_batch(bronze, batch, batch_id, "customer_id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.table(bronze).count() == 6000
    first = _ranges(spark.table(bronze).filter("batch_id = 0").inputFiles(), "customer_id")
    assert len(first) == 4
    for key in (0, 333, 999):
        assert sum(low <= key <= high for _, low, high in first) <= 2
    assert sum(high > low for _, low, high in first) == 4 and sum(high - low for _, low, high in first) < 1000
    second = spark.table(bronze).filter("batch_id = 1")
    per_file = [n for _, n in rows(second.filter("customer_id = 500").groupBy(F.input_file_name()).count())]
    assert len(per_file) >= 2 and max(per_file) < 900
    times = _ranges(spark.table(bronze).inputFiles(), "inserted_time")
    assert {p for p, _, high in times if high.date() >= date(2024, 1, 2)} == set(second.inputFiles())
    transactions(s, "t.json", *[(str(i), (i * 7919) % 1000, 1, 1, 1.0, f"2024-0{1 + i % 2}-01", "card", "web") for i in range(500)])
    ingest(spark, TRANSACTIONS, s)
    pipeline.load_transactions(spark, s)
    for path in table(spark, s, "silver", "transactions_si").inputFiles():
        ids = pq.read_table(path.removeprefix("file://").removeprefix("file:"), columns=["customer_id"])["customer_id"].to_pylist()
        assert len(ids) > 0 and ids == sorted(ids)


def test_number_of_slices_outlives_the_session(spark, tmp_path, rows):
    """Another number of shuffle partitions or buckets does not change tables that stand."""
    s = Settings(root=str(tmp_path), env="lasting", buckets=4)
    pipeline.run_setup(spark, s)
    customers(s, "c1.csv", *[f"{i},Ann,ann@x,NL,new,2024-01-01,18,f,1" for i in range(20)])
    pipeline.run_bronze(spark, s, ["customers"])
    pipeline.load_customers(spark, s)
    for name in ("customers_si", "customers_si_slices"):
        spark.sql(f"DROP {'TABLE' if name.endswith('slices') else 'VIEW'} {s.table('silver', name)}")
    again = Settings(root=str(tmp_path), env="lasting", buckets=7)
    pipeline.run_setup(spark, again)
    customers(again, "c2.csv", *[f"{i},Bob,bob@x,NL,new,2024-01-01,18,f,1" for i in range(10, 30)])
    pipeline.run_bronze(spark, again, ["customers"])
    pipeline.load_customers(spark, again)
    found = table(spark, again, "silver", "customers_si").groupBy("name").count()
    assert rows(found) == [("Ann", 10), ("Bob", 20)]


def test_fact_lookup_prunes_months_at_run_time(spark, settings, rows):
    s = settings
    pipeline.run_setup(spark, s)
    for name in ("t1.json", "t2.json"):
        transactions(s, name, ("a", 1, 1, 1, 1.0, "2024-01-01", "card", "web"), (name, 1, 1, 1, 1.0, "2024-02-01", "card", "web"))
        ingest(spark, TRANSACTIONS, s)
        pipeline.load_transactions(spark, s)
    assert rows(table(spark, s, "silver", "transactions_si"), "transaction_id", "_commit_version") == [
        ("a", 0), ("t1.json", 0), ("t2.json", 1),
    ]
    batch = table(spark, s, "bronze", "transactions_bz").filter("batch_id = 1")
    looked_up = pipeline.facts_of_months(table(spark, s, "silver", "transactions_si"), batch)
    assert "dynamicpruning" in looked_up._jdf.queryExecution().toString().lower()


def test_root_that_looks_like_a_version(spark, settings, rows):
    s = Settings(root=f"{settings.root}/v5/lake", env=settings.env)
    pipeline.run_setup(spark, s)
    assert version_in(f"{s.root}/x/initial") == -1
    assert version_in("/v5/lake/x/v3") == 3 and version_in("/v5/x/v7/month=2024-01") == 7
    transactions(s, "t.json", ("a", 1, 1, 1, 1.0, "2024-01-01", "card", "web"))
    ingest(spark, TRANSACTIONS, s)
    pipeline.load_transactions(spark, s)
    assert rows(table(spark, s, "silver", "transactions_si"), "transaction_id") == [("a",)]


def test_lost_table_is_noticed(spark, settings):
    """Dropped with its files: a stream that went on would never read them again."""
    s = settings
    pipeline.run_setup(spark, s)
    transactions(s, "t.json", ("a", 1, 1, 1, 1.0, "2024-01-01", "card", "web"))
    ingest(spark, TRANSACTIONS, s)
    spark.sql(f"DROP TABLE {s.table('bronze', 'transactions_bz')}")
    os.rename(f"{s.layer_path('bronze')}/transactions_bz", f"{s.root}/lost")
    pipeline.run_setup(spark, s)
    with pytest.raises(TableLost):
        ingest(spark, TRANSACTIONS, s)


def test_unknown_products_are_counted(spark, settings):
    s = settings
    pipeline.run_setup(spark, s)
    transactions(s, "t.json", *[(f"t{i}", 1, 7, 1, 1.0, "2024-01-01", "card", "web") for i in range(3)])
    ingest(spark, TRANSACTIONS, s)
    pipeline.load_transactions(spark, s)
    assert pipeline.update_product_sales(spark, s) == {0: 3}
    assert table(spark, s, "gold", "product_sales_summary_gd").count() == 0
    assert pipeline.update_customer_stats(spark, s, AS_OF) == {0: 3}
    assert table(spark, s, "gold", "customers_stats_gd").count() == 0


def test_silver_straight_from_a_stream(spark, settings, rows):
    """The batch steps are also foreachBatch bodies."""
    s = settings
    pipeline.run_setup(spark, s)
    customers(s, "c1.csv", "1,Ann,ann@x,NL,new,2024-01-01,18,f,1", "1,Ann,null,NL,new,2024-01-01,18,f,1")
    query = (
        stream_feed(spark, CUSTOMERS, s.landing_path("customers"))
        .writeStream.option("checkpointLocation", s.checkpoint_path("direct"))
        .foreachBatch(lambda batch, n: pipeline.apply_customers(batch.sparkSession, s, batch, n, AS_OF))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark.catalog.refreshTable(s.table("silver", "customers_si"))
    assert rows(table(spark, s, "silver", "customers_si"), "customer_id", "days_since_registration") == [(1, 181)]


def test_many_versions_in_one_fold(spark, tmp_path, rows, monkeypatch):
    """Fifty pending versions give the marts that one at a time gives, and are published once."""
    facts = [
        (f"t{i}", 1 + i % 3, 1 + i % 2, i % 4, [0.37 * i, None, 0.004][i % 3], f"2024-0{1 + i % 3}-1{i % 5}",
         ["card", None][i % 2], "web")
        for i in range(200)
    ]
    published, real = [], pipeline.publish_snapshot
    monkeypatch.setattr(pipeline, "publish_snapshot", lambda spark, table, *a, **k: (published.append(table), real(spark, table, *a, **k)))
    results = []
    for tag, runs in (("once", [50]), ("some", [1, 2, 46, 1])):
        s = tables.Settings(root=str(tmp_path / tag), env=f"fold_{tag}", buckets=2)
        pipeline.run_setup(spark, s)
        customers(s, "c.csv", *[f"{i},n{i},m{i},NL,new,2024-01-01,30,f,1" for i in (1, 2)])
        products(s, "p.json", (1, "pen", 5.0, 4.0, "7"), (2, "ink", 3.0, 3.0, "3"))
        pipeline.run_bronze(spark, s, ("customers", "products"))
        pipeline.load_customers(spark, s, AS_OF)
        pipeline.load_products(spark, s)
        silver, version = s.table("silver", "transactions_si"), 0
        cleaned = spark.createDataFrame(
            [(*f[:5], date.fromisoformat(f[5]), *f[6:], "Completed", datetime(2024, 7, 1), f[5][:7], datetime(2024, 7, 1)) for f in facts],
            ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.table(silver).schema if f.name != "_commit_version"
                      and f.name not in ("transaction_month", "_commit_timestamp")) + ", transaction_month STRING, _commit_timestamp TIMESTAMP",
        )
        cleaned.withColumn("_commit_version", F.expr("pmod(int(substr(transaction_id, 2)), 50)")).write.partitionBy(
            "_commit_version", "transaction_month"
        ).mode("append").parquet(tables.location_of(spark, silver))
        spark.sql(f"ALTER TABLE {silver} RECOVER PARTITIONS")
        lost = 0
        for run in runs:
            version += run
            cursors.write_cursor(spark, s.table("silver", "meta_si"), "transactions_si", version - 1)
            published.clear()
            folded = pipeline.run_gold(spark, s, AS_OF)
            lost += folded["customers_stats_gd"][version - 1]
            gold = [t for t in published if ".sales_summary" in t or ".customers_stats" in t]
            assert len(gold) == 2
        meta = spark.table(s.table("silver", "meta_si")).filter("table_name = 'customers_stats_gd'").first()
        assert meta.last_version == 49 and meta.facts_lost == lost
        results.append([lost, *[rows(table(spark, s, "gold", g).drop("last_updated")) for g in pipeline.GOLD]])
    assert results[0] == results[1]
    assert results[0][0] > 0


def test_a_version_that_stands_is_not_written_again(spark, settings, rows):
    s = settings
    pipeline.run_setup(spark, s)
    transactions(s, "t.json", ("a", 1, 1, 1, 1.0, "2024-01-01", "card", "web"))
    ingest(spark, TRANSACTIONS, s)
    pipeline.load_transactions(spark, s)
    silver = s.table("silver", "transactions_si")
    before = rows(spark.table(silver))
    # As after a crash between writing and the catalog: the folder is there, the partition is not.
    spark.sql(f"ALTER TABLE {silver} DROP PARTITION (_commit_version = 0, transaction_month = '2024-01')")
    cursors.write_cursor(spark, s.table("silver", "meta_si"), "transactions_si", -1)
    pipeline.load_transactions(spark, s)
    assert rows(spark.table(silver)) == before


def test_changes_after_a_time(spark, settings, rows):
    s = settings
    pipeline.run_setup(spark, s)
    silver = s.table("silver", "transactions_si")
    for v in range(6):
        # Version 3 brings no row.
        transactions(s, f"t{v}.json", (f"t{v}", None if v == 3 else 1, 1, 1, 1.0, "2024-01-01", "card", "web"))
        ingest(spark, TRANSACTIONS, s)
        batch = table(spark, s, "bronze", "transactions_bz").filter(f"batch_id = {v}")
        pipeline.apply_transactions(spark, s, batch, v, F.lit(datetime(2024, 1, 1 + v)))
    for time, first in ((datetime(2023, 1, 1), 0), (datetime(2024, 1, 1), 1), (datetime(2024, 1, 2, 12), 2), (datetime(2024, 1, 3), 4),
                        (datetime(2024, 1, 4), 4), (datetime(2024, 1, 6), 6), (datetime(2025, 1, 1), 6)):
        got = rows(read_changes_after(spark, silver, time), "transaction_id", "_change_type")
        assert got == [(f"t{v}", "insert") for v in range(first, 6) if v != 3]


def test_null_counts_are_refused(spark, settings, rows):
    """A NOT NULL column is checked by the job that writes; the table keeps what it had."""
    s = settings
    pipeline.run_setup(spark, s)
    state = s.table("gold", "sales_summary_state")
    good = spark.createDataFrame([(date(2024, 1, 1), "w", "c", None, 0, 3, 1, None)], spark.table(state).schema)
    tables.publish_snapshot(spark, state, good, 0, not_null=["total_transactions"])
    with pytest.raises(NotNullViolated) as refused:
        tables.publish_snapshot(spark, state, good.withColumn("total_transactions", F.lit(None).cast("bigint")), 1,
                                not_null=["total_transactions"])
    assert refused.value.count == 1
    assert tables.snapshot_version(spark, state) == 0
    assert rows(spark.table(state), "total_transactions") == [(3,)]


FIRST_PROCESS = """
import sys
sys.path[:0] = [{repo!r}, {tests!r}]
from varve.session import build_session
from varve.sources.tables import Settings
from varve.plans import pipeline
import test_pipeline as t
spark = build_session("first", master="local[2]", extra={{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
    "spark.sql.warehouse.dir": {root!r} + "/warehouse"}})
s = Settings(root={root!r}, env="two_processes", buckets=4)
pipeline.run_setup(spark, s)
t.first_round(s)
t.run_all(spark, s)
spark.stop()
"""


def test_two_processes_equal_one(spark, two_rounds, tmp_path, rows):
    """The first process ends with its catalog; the second finds tables, versions and cursors in the folders."""
    tests = os.path.dirname(os.path.abspath(__file__))
    program = FIRST_PROCESS.format(repo=os.path.dirname(tests), tests=tests, root=str(tmp_path))
    done = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    s = Settings(root=str(tmp_path), env="two_processes", buckets=4)
    pipeline.run_setup(spark, s)
    assert cursors.read_cursor(spark, s.table("silver", "meta_si"), "customers_stats_gd") == 0
    assert table(spark, s, "gold", "customers_stats_gd").count() > 0
    second_round(s)
    run_all(spark, s)
    whole, _ = two_rounds
    stamps = ("last_updated", "inserted_time", "source_modified", "start_date", "end_date", "_commit_timestamp", "last_inserted_time")
    for layer, names in (("bronze", ["customers_bz", "products_bz", "transactions_bz"]),
                         ("silver", ["customers_si", "products_si", "transactions_si", "customers_si_changes", "meta_si"]),
                         ("gold", list(pipeline.GOLD))):
        for name in names:
            assert rows(table(spark, s, layer, name).drop(*stamps)) == rows(table(spark, whole, layer, name).drop(*stamps)), name


def test_recovery_leaves_out_what_was_cut_off(spark, settings, rows):
    """A version without its end mark is no partition; the newest complete snapshot is the table."""
    s = settings
    pipeline.run_setup(spark, s)
    first_round(s)
    run_all(spark, s)
    second_round(s)
    run_all(spark, s)
    names = [("silver", "transactions_si"), ("silver", "customers_si"), ("gold", "product_sales_state")]
    before = {n: rows(table(spark, s, *n)) for n in names}
    facts = f"{s.layer_path('silver')}/transactions_si"
    shutil.copytree(f"{facts}/_commit_version=1", f"{facts}/_commit_version=2", ignore=shutil.ignore_patterns("_SUCCESS"))
    snapshot = f"{s.layer_path('silver')}/customers_si"
    shutil.copytree(f"{snapshot}/v0", f"{snapshot}/v7", ignore=shutil.ignore_patterns("_SUCCESS"))
    for layer in ("bronze", "silver", "gold"):
        for t in spark.catalog.listTables(s.database(layer)):
            kind = "VIEW" if t.tableType == "VIEW" else "TABLE"
            if t.namespace:
                spark.sql(f"DROP {kind} {s.table(layer, t.name)}")
    pipeline.run_setup(spark, s)
    assert {n: rows(table(spark, s, *n)) for n in names} == before
    assert run_all(spark, s)["sales_summary_gd"] == {}


def test_lost_table_is_noticed_after_commits_are_purged(spark, settings):
    """Streams keep their last commits only: any of them tells that files were consumed."""
    s = settings
    pipeline.run_setup(spark, s)
    spark.conf.set("spark.sql.streaming.minBatchesToRetain", "2")
    try:
        for i in range(5):
            customers(s, f"c{i}.csv", f"{i},Ann,ann@x,NL,new,2024-01-01,18,f,1")
        ingest(spark, CUSTOMERS, s, max_files=1)
    finally:
        spark.conf.unset("spark.sql.streaming.minBatchesToRetain")
    assert not os.path.exists(f"{s.checkpoint_path('customers')}/commits/0")
    bronze = s.table("bronze", "customers_bz")
    spark.sql(f"DROP TABLE {bronze}")
    os.rename(f"{s.layer_path('bronze')}/customers_bz", f"{s.root}/lost")
    pipeline.run_setup(spark, s)
    with pytest.raises(TableLost):
        ingest(spark, CUSTOMERS, s)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_facts_are_shuffled_once(spark, settings, rows, monkeypatch):
    """Compared with each other and with standing facts, and written, where one shuffle brings them."""
    pipeline.run_setup(spark, settings)
    ddl = f"{schemas.TRANSACTIONS_BZ}, {BATCH} BIGINT"

    def fact(id_, amount, day, batch, at=1):
        return (id_, 1, 1, 6, amount, day, "card", "web", datetime(2024, 7, at), None, batch)

    written = []
    append = pipeline.append_versions

    def watched(spark, table, facts, *args, **kwargs):
        written.append((_plan(facts).count("Exchange shufflepartitionid"), kwargs.get("spread")))
        append(spark, table, facts, *args, **kwargs)

    monkeypatch.setattr(pipeline, "append_versions", watched)
    monkeypatch.setattr(pipeline, "ROWS_OF_PART", 8)
    january = [fact(f"t{i}", float(i), f"2024-01-{i % 28 + 1:02}", 0) for i in range(30)]
    early = [*january, fact("t0", 99.0, "2024-01-01", 0, at=2), fact("a", 1.0, "2024-02-01", 0), fact(None, 1.0, "2024-02-01", 0)]
    pipeline.apply_transaction_batches(spark, settings, spark.createDataFrame(early, ddl), [0])
    late = [fact("t0", 50.0, "2024-01-01", 1), fact("t1", 50.0, "2024-01-03", 1), fact("a", 5.0, "2024-02-01", 2),
            fact("b", 7.0, "2024-02-01", 2), fact("b", 6.0, "2024-02-01", 1), fact("b", 9.0, "bad", 1),
            fact(None, 2.0, "2024-02-01", 1), fact(None, 3.0, "2024-02-01", 2)]
    pipeline.apply_transaction_batches(spark, settings, spark.createDataFrame(late, ddl), [1, 2])
    facts = spark.table(settings.table("silver", "transactions_si"))
    got = rows(facts.selectExpr("transaction_id", "transaction_date", "total_amount", "_commit_version", "transaction_month"))
    first = [(f"t{i}", date(2024, 1, i % 28 + 1), 99.0 if i == 0 else float(i), 0, "2024-01") for i in range(30)]
    february = [("a", 1.0, 0), (None, 1.0, 0), ("b", 6.0, 1), (None, 2.0, 1)]
    second = [("t1", date(2024, 1, 3), 50.0, 1, "2024-01"), *[(i, date(2024, 2, 1), n, v, "2024-02") for i, n, v in february]]
    assert got == sorted(first + second, key=repr)
    assert written == [(1, False), (1, False)]
    # A month of more rows than a part is written by several tasks.
    files = facts.filter("_commit_version = 0 AND transaction_month = '2024-01'").selectExpr("_metadata.file_path").distinct()
    assert files.count() > 1


def test_parts_of_months(spark, monkeypatch):
    monkeypatch.setattr(pipeline, "ROWS_OF_PART", 32)
    part, parts = pipeline._parts_of_months({"2024-01": 1, "2024-02": 1, "2024-03": 100, "2024-04": 2, "2024-05": 33})
    ids = spark.range(400).selectExpr("cast(id as string) AS transaction_id", "date'2024-01-01' AS day")
    of = {}
    for month in range(1, 7):
        dated = ids.select("transaction_id", F.add_months("day", month - 1).alias("transaction_date"))
        of[month] = {r[0] for r in dated.select(part).distinct().collect()}
    assert parts == 8 and of == {1: {0}, 2: {0}, 3: {1, 2, 3, 4}, 4: {5}, 5: {6, 7}, 6: {0}}
    assert pipeline._parts_of_months({})[1] == 1


def test_unkeyed_batches_are_not_shuffled(spark, settings):
    pipeline.run_setup(spark, settings)
    bronze = settings.table("bronze", "transactions_bz")
    some = spark.range(90).selectExpr("cast(id AS string) AS transaction_id", "cast(id AS int) AS customer_id")
    columns = [F.col(c) if c in some.columns else F.lit(None).alias(c) for c in schemas.columns(schemas.TRANSACTIONS_BZ)]
    land_batch(bronze, some.repartition(3).select(*columns), 0)
    files = {r[0].rsplit("/", 1)[1] for r in spark.table(bronze).selectExpr("_metadata.file_path").distinct().collect()}
    assert len(files) == 3 and all(f.endswith(".zstd.parquet") for f in files)
    assert spark.table(bronze).count() == 90


def test_customer_totals_shuffle_once(spark, rows):
    days = "explode(sequence(date'2023-12-30', date'2024-02-01'))"
    tx = spark.sql(f"SELECT 1 AS customer_id, {days} AS transaction_date, 'a' AS transaction_id, 1.5 AS total_amount, 'Completed' AS order_status")
    tx = tx.unionByName(tx.limit(1).withColumns({"customer_id": F.lit(2), "transaction_date": F.lit(None).cast("date")}))
    totals = marts.customer_totals(tx)
    assert _plan(marts.customer_totals(spark.range(9).selectExpr(
        "cast(id AS int) AS customer_id", "date'2024-01-01' AS transaction_date", "'a' AS transaction_id",
        "1.5 AS total_amount", "'Completed' AS order_status"))).count("Exchange hash") == 1
    got = {r["customer_id"]: r for r in totals.collect()}
    assert got[1]["order_days"] == {2023 * 12 + 12: 3 << 29, 2024 * 12 + 1: 2**31 - 1, 2024 * 12 + 2: 1}
    assert (got[1]["first_order_date"], got[1]["last_order_date"]) == (date(2023, 12, 30), date(2024, 2, 1))
    assert got[2]["order_days"] == {} and got[2]["first_order_date"] is None and got[2]["total_transactions"] == 1
