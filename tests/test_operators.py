"""Dedup, merges, history and change rows on small frames."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from varve.operators import (
    additive_merge,
    apply_changes,
    high_watermark,
    insert_only,
    latest_by_key,
    merge,
    new,
    newer_than,
    old,
    rows_not_in,
    scd2_merge,
    upsert,
)
from varve.operators.watermark import BEGINNING
from varve.plans import marts
from varve.plans.clean import clean_customers, clean_products, clean_transactions

T1, T2, T3 = datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 3)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Dedup --------------------------------------------------------------------------------------


def test_latest_by_key(spark, rows):
    df = spark.createDataFrame(
        [(1, T1, "a"), (1, T2, "b"), (1, T2, "c"), (2, T1, "d"), (None, T1, "e"), (None, T2, "f")],
        "k INT, at TIMESTAMP, v STRING",
    )
    assert rows(latest_by_key(df, ["k"], ["at"]), "k", "v") == [(1, "c"), (2, "d"), (None, "f")]
    assert latest_by_key(df.limit(0), ["k"], ["at"]).count() == 0


def test_latest_by_key_folds_before_the_shuffle(spark):
    df = spark.range(10).withColumn("k", F.col("id") % 3)
    text = plan(latest_by_key(df, ["k"], ["id"]))
    assert "partial_max" in text[text.index("Exchange"):]


def test_hot_key_keeps_one_row(spark, rows):
    df = spark.range(60_000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")))
    latest = latest_by_key(df, ["k"], ["id"])
    assert latest.count() == 40_001
    assert latest.filter("k = 0").first().id == 59_997


def test_rows_not_in_is_null_safe(spark, rows):
    left = spark.createDataFrame([(1, "a"), (2, None), (None, None), (3, "x|y")], "k INT, v STRING")
    right = spark.createDataFrame([(2, None), (None, None), (3, "x")], "k INT, v STRING")
    assert rows(rows_not_in(left, right, ["k", "v"])) == [(1, "a"), (3, "x|y")]
    assert "NestedLoop" not in plan(rows_not_in(left, right, ["k", "v"]))


def test_watermark(spark):
    df = spark.createDataFrame([(T1,), (T3,)], "at TIMESTAMP")
    assert high_watermark(df, "at") == T3
    assert high_watermark(df.limit(0), "at") == BEGINNING
    assert [r.at for r in newer_than(df, "at", T1).collect()] == [T3]
    assert newer_than(df, "at").count() == 2


# Merges -------------------------------------------------------------------------------------


@pytest.fixture
def target(spark):
    return spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 0)], "k INT, v STRING, n INT")


def test_upsert(spark, target, rows):
    source = spark.createDataFrame([(2, "B", 20, T1), (3, "C", 30, T1)], "k INT, v STRING, n INT, extra TIMESTAMP")
    merged = upsert(target, source, ["k"])
    assert rows(merged.rows) == [(1, "a", 1), (2, "B", 20), (3, "C", 30), (None, "n", 0)]
    assert rows(merged.changes) == [
        (2, "B", 20, "update_postimage"), (2, "b", 2, "update_preimage"), (3, "C", 30, "insert"),
    ]
    assert rows(apply_changes(target, merged.changes, ["k"])) == rows(merged.rows)


def test_null_keys_are_inserted_each_time(spark, target, rows):
    source = spark.createDataFrame([(None, "x", 1), (None, "y", 2)], "k INT, v STRING, n INT")
    merged = upsert(target, source, ["k"])
    assert rows(merged.rows.filter("k IS NULL"), "v") == [("n",), ("x",), ("y",)]
    assert rows(merged.changes, "v", "_change_type") == [("x", "insert"), ("y", "insert")]


def test_empty_sides(spark, target, rows):
    assert rows(upsert(target, target.limit(0), ["k"]).rows) == rows(target)
    assert upsert(target, target.limit(0), ["k"]).changes.count() == 0
    assert rows(upsert(target.limit(0), target, ["k"]).rows) == rows(target)


def test_repeated_source_keys_are_refused(spark, target):
    source = spark.createDataFrame([(2, "B", 1), (2, "C", 2)], "k INT, v STRING, n INT")
    with pytest.raises(Exception, match="several rows for one key"):
        upsert(target, source, ["k"]).rows.collect()


def test_history_refuses_repeated_source_keys(spark):
    history = spark.createDataFrame(
        [], "k INT, v STRING, last_updated STRING, is_active BOOLEAN, start_date STRING, end_date STRING"
    )
    source = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "k INT, v STRING, inserted_time STRING")
    for outcome in (scd2_merge(history, source, "k").rows, scd2_merge(history, source, "k").changes):
        with pytest.raises(Exception, match="several rows for one key"):
            outcome.collect()


def test_merge_with_condition(spark, target, rows):
    source = spark.createDataFrame([(1, "z", 0), (2, "z", 5)], "k INT, v STRING, n INT")
    values = {c: new(c) for c in target.columns}
    merged = merge(target, source, ["k"], values, values, when=new("n") > old("n"))
    assert rows(merged.rows) == [(1, "a", 1), (2, "z", 5), (None, "n", 0)]
    assert merged.changes.count() == 2


def test_insert_only(spark, rows):
    target = spark.createDataFrame([("a", date(2024, 1, 1), 1)], "id STRING, d DATE, n INT")
    source = spark.createDataFrame(
        [("a", date(2024, 1, 1), 9), ("a", date(2024, 1, 2), 9), ("b", None, 9)], "id STRING, d DATE, n INT"
    )
    assert rows(insert_only(target, source, ["id", "d"])) == [("a", date(2024, 1, 2), 9), ("b", None, 9)]
    assert insert_only(target, source, ["id", "d"]).columns == ["id", "d", "n"]


def test_additive_merge_sees_values_from_before(spark, rows):
    mart = spark.createDataFrame([("x", 10, 2, 5.0), (None, 1, 1, 1.0)], "k STRING, s INT, n INT, avg DOUBLE")
    batch = spark.createDataFrame([("x", 5, 1, 5.0), (None, 2, 1, 2.0), ("y", 7, 1, 7.0)], mart.schema)
    s, n = old("s") + new("s"), old("n") + new("n")
    merged = additive_merge(mart, batch, ["k"], {"s": s, "n": n, "avg": s / n})
    assert rows(merged.rows) == [("x", 15, 3, 5.0), ("y", 7, 1, 7.0), (None, 3, 2, 1.5)]


# History ------------------------------------------------------------------------------------

PRODUCT = "product_id BIGINT, price DOUBLE, rating DOUBLE, inserted_time TIMESTAMP"
HISTORY = (
    "product_id BIGINT, price DOUBLE, rating DOUBLE, last_updated TIMESTAMP, is_active BOOLEAN, "
    "start_date TIMESTAMP, end_date TIMESTAMP"
)


def history_of(spark, *batches, **kwargs):
    history = spark.createDataFrame([], HISTORY)
    for batch in batches:
        history = scd2_merge(history, spark.createDataFrame(batch, PRODUCT), "product_id", **kwargs).rows
    return history


def test_price_change_closes_and_opens(spark, rows):
    history = history_of(spark, [(1, 5.0, 4.0, T1), (2, 1.0, 1.0, T1)], [(1, 6.0, 4.0, T2), (2, 1.0, 1.0, T2)])
    assert rows(history, "product_id", "price", "is_active", "start_date", "end_date") == [
        (1, 5.0, False, T1, T2), (1, 6.0, True, T2, None), (2, 1.0, True, T1, None),
    ]


def test_there_and_back_is_three_versions(spark, rows):
    history = history_of(spark, [(1, 5.0, 4.0, T1)], [(1, 6.0, 4.0, T2)], [(1, 5.0, 4.0, T3)])
    assert rows(history, "price", "start_date", "end_date") == [(5.0, T1, T2), (5.0, T3, None), (6.0, T2, T3)]


@pytest.mark.parametrize("later", [(1, 5.0, 3.0, T2), (1, None, 4.0, T2)])
def test_any_tracked_column_makes_a_version(spark, later):
    history = history_of(spark, [(1, 5.0, 4.0, T1)], [later])
    assert history.count() == 2 and history.filter("is_active").count() == 1


def test_track_cols(spark):
    history = history_of(spark, [(1, 5.0, 4.0, T1)], [(1, 5.0, 3.0, T2)], track_cols=["price"])
    assert history.count() == 1


def test_third_change_opens_one_version(spark):
    batches = [[(1, float(i), 4.0, datetime(2024, 1, i))] for i in range(1, 5)]
    history = history_of(spark, *batches)
    assert (history.count(), history.filter("is_active").count()) == (4, 1)


def test_history_laws(spark, rows):
    """One active row per key, intervals without gaps, and changes that replay."""
    batches = [[(k, float((k * b) % 3), 1.0, datetime(2024, 1, b)) for k in range(b, b + 6)] for b in range(1, 5)]
    history = history_of(spark, *batches)
    active = history.filter("is_active").groupBy("product_id").count()
    assert active.filter("count <> 1").count() == 0
    a, b = history.alias("a"), history.alias("b")
    nexts = a.filter("end_date IS NOT NULL").join(
        b, F.expr("a.product_id = b.product_id AND a.end_date = b.start_date"), "left_outer"
    )
    assert nexts.filter("b.product_id IS NULL").count() == 0
    step = scd2_merge(history, spark.createDataFrame([(1, 99.0, 1.0, T3)], PRODUCT), "product_id")
    replayed = apply_changes(history, step.changes, ["product_id", "start_date"])
    assert rows(replayed) == rows(step.rows)


# Cleaning -----------------------------------------------------------------------------------


def test_invalid_duplicate_does_not_hide_a_valid_row(spark, rows):
    schema = ("customer_id INT, name STRING, email STRING, country STRING, customer_type STRING, "
              "registration_date DATE, age INT, gender STRING, total_purchases INT, inserted_time TIMESTAMP")
    base = ("NL", "new", date(2024, 1, 1))
    df = spark.createDataFrame(
        [(1, "ok", "a@x", *base, 30, "f", 5, T1), (1, "bad", "a@x", *base, 17, "f", 5, T2),
         (2, "neg", "b@x", *base, 30, "f", -1, T1), (3, "edge", "c@x", *base, 100, "f", 0, T1),
         (4, "old", "d@x", *base, 101, "f", 0, T1), (5, "noage", "e@x", *base, None, "f", 0, T1),
         (6, "nop", "f@x", *base, 18, "f", None, T1)], schema)
    assert rows(clean_customers(df, date(2024, 1, 31)), "name", "days_since_registration") == [("edge", 30), ("ok", 30)]


def test_clean_products_clamps_before_categories(spark, rows):
    schema = ("brand STRING, category STRING, name STRING, price DOUBLE, product_id BIGINT, rating DOUBLE, "
              "stock_quantity STRING, inserted_time TIMESTAMP")
    df = spark.createDataFrame(
        [("b", "c", "n", -1.0, 1, 6.0, "-3", T1), ("b", "c", "n", None, 2, None, None, T1)], schema)
    assert rows(clean_products(df), "product_id", "price", "rating", "stock_quantity", "price_category", "stock_status") == [
        (1, 0.0, 5.0, "0", "Budget", "Out of Stock"), (2, None, None, None, "Budget", "Sufficient Stock"),
    ]


TX = ("transaction_id STRING, customer_id INT, product_id INT, quantity INT, total_amount DOUBLE, "
      "transaction_date STRING, payment_method STRING, store_type STRING, inserted_time TIMESTAMP")


def test_clean_transactions(spark, rows):
    df = spark.createDataFrame(
        [("a", 1, 1, -1, 5.0, "2024-01-01", "c", "w", T1), ("b", 1, 1, None, -5.0, "2024-01-01", "c", "w", T1),
         ("c", None, 1, 1, 5.0, "2024-01-01", "c", "w", T1), ("d", 1, None, 1, 5.0, "2024-01-01", "c", "w", T1),
         ("e", 1, 1, 1, 5.0, "NULL", "c", "w", T1), ("f", 1, 1, None, None, "2024-01-01", "c", "w", T1),
         ("a", 1, 1, 2, 5.0, "2024-01-01", "c", "w", T2), ("a", 1, 1, 2, 5.0, "2024-01-02", "c", "w", T1)], TX)
    assert rows(clean_transactions(df), "transaction_id", "transaction_date", "quantity", "total_amount", "order_status") == [
        ("a", date(2024, 1, 1), 2, 5.0, "Completed"), ("a", date(2024, 1, 2), 2, 5.0, "Completed"),
        ("b", date(2024, 1, 1), None, 0.0, "Cancelled"), ("f", date(2024, 1, 1), None, None, "Completed"),
    ]


# Marts --------------------------------------------------------------------------------------


def facts(spark, *items):
    schema = ("transaction_id STRING, customer_id INT, product_id INT, quantity INT, total_amount DOUBLE, "
              "transaction_date DATE, payment_method STRING, store_type STRING, order_status STRING")
    return spark.createDataFrame(list(items), schema)


D1, D2 = date(2024, 1, 1), date(2024, 1, 2)


def test_null_amounts_and_methods(spark, rows):
    first = facts(spark, ("a", 1, 1, 1, None, D1, None, "w", "Completed"))
    second = facts(spark, ("b", 1, 1, None, 2.5, D1, None, "w", "Completed"), ("c", 1, 1, 1, 9.0, D1, None, "w", "Cancelled"))
    assert rows(marts.sales_summary(first), "total_sales", "total_transactions", "avg_order_value") == [(None, 1, None)]
    folded = marts.fold_sales(marts.sales_state(first), marts.sales_state(second)).rows.selectExpr(*marts.SALES_SHOWN)
    # The average is that of the known amounts, as in one batch.
    assert rows(folded, "total_sales", "total_transactions", "avg_order_value", "total_quantity_sold") == [(2.5, 2, 2.5, 1)]
    assert rows(folded.drop("last_updated")) == rows(marts.sales_summary(first.union(second)).drop("last_updated"))


def _split(items, n):
    return [items[i::n] for i in range(n)]


@pytest.mark.parametrize("batches", [2, 4])
def test_marts_do_not_depend_on_batches(spark, rows, batches):
    """Unknown amounts and amounts below a cent, in one batch and in several."""
    amount = [10.0, None, 20.0, 0.004, 0.004, 0.004, float("nan"), -0.005, 1e20, 0.01]
    items = [
        (f"t{i}", 1 + i % 2, 1 + i % 3, None if i % 7 == 0 else i % 5, amount[i % len(amount)],
         date(2024, 1 + i % 3, 1 + i % 31 % 28), ["c", None][i % 2], "w", "Cancelled" if i % 11 == 0 else "Completed")
        for i in range(80)
    ]
    customers = spark.createDataFrame([(1, "n", "e")], "customer_id INT, name STRING, email STRING")
    active = spark.createDataFrame(
        [(1, "n", "b", "c", "Budget"), (2, None, "b", "c", "Budget")],
        "product_id BIGINT, name STRING, brand STRING, category STRING, price_category STRING")

    def customer(tx):
        return marts.customer_state(marts.with_customer(marts.customer_totals(tx), customers), D1)

    def product(tx):
        return marts.product_state(marts.with_product(marts.product_days(tx), active))

    whole = facts(spark, *items)
    for state, fold, shown, one_shot in (
        (marts.sales_state, marts.fold_sales, marts.SALES_SHOWN, marts.sales_summary(whole)),
        (customer, lambda a, b: marts.fold_customers(a, b, D1), marts.CUSTOMERS_SHOWN, marts.customer_stats(whole, customers, D1)),
        (product, marts.fold_products, marts.PRODUCTS_SHOWN, marts.product_sales(whole, active)),
    ):
        folded = None
        for part in _split(items, batches):
            batch = state(facts(spark, *part))
            folded = batch if folded is None else fold(folded, batch).rows
        assert rows(folded.selectExpr(*shown).drop("last_updated")) == rows(one_shot.drop("last_updated"))


def test_averages_of_ten_and_twenty(spark, rows):
    """10, unknown, 20: 15, however they come."""
    ten, unknown, twenty = (facts(spark, (i, 1, 1, 1, a, D1, "c", "w", "Completed")) for i, a in (("a", 10.0), ("b", None), ("c", 20.0)))
    folded = marts.fold_sales(marts.fold_sales(marts.sales_state(ten), marts.sales_state(unknown)).rows, marts.sales_state(twenty)).rows
    assert rows(folded.selectExpr(*marts.SALES_SHOWN), "avg_order_value", "total_transactions") == [(15.0, 3)]


def test_a_day_seen_twice_counts_once(spark, rows):
    customers = spark.createDataFrame([(1, "n", "e")], "customer_id INT, name STRING, email STRING")
    batches = [facts(spark, ("a", 1, 1, 1, 1.0, D1, "c", "w", "Completed")),
               facts(spark, ("b", 1, 1, 1, 3.0, D1, "c", "w", "Completed"), ("c", 1, 1, 1, 5.0, D2, "c", "w", "Completed"),
                     ("d", 7, 1, 1, 5.0, D2, "c", "w", "Completed"))]
    as_of, state = date(2024, 2, 1), None
    for tx in batches:
        batch = marts.customer_state(marts.with_customer(marts.customer_totals(tx), customers), as_of)
        state = batch if state is None else marts.fold_customers(state, batch, as_of).rows
    assert rows(state.selectExpr(*marts.CUSTOMERS_SHOWN), "customer_id", "distinct_transaction_dates", "total_transactions",
                "total_spent", "recency_days") == [(1, 2, 3, 9.0, 30)]


def test_days_of_every_month_and_year(spark, rows):
    """Bits of the first and last days of months, far apart; a fact without a date has no day."""
    customers = spark.createDataFrame([(1, "n", "e")], "customer_id INT, name STRING, email STRING")
    days = [date(1, 1, 1), date(1999, 12, 31), date(2000, 1, 1), date(2000, 1, 31), date(2024, 2, 29), date(9999, 12, 31), None]
    tx = facts(spark, *[(f"{n}-{d}", 1, 1, 1, 1.0, d, "c", "w", "Completed") for n in range(3) for d in days])
    assert rows(marts.customer_stats(tx, customers, D1), "distinct_transaction_dates", "total_transactions") == [(6, 21)]


def test_cancelled_orders_count_for_products_only(spark, rows):
    tx = facts(spark, ("a", 1, 1, 0, 4.0, D1, "c", "w", "Cancelled"), ("b", 1, 2, 1, 4.0, D1, "c", "w", "Completed"))
    active = spark.createDataFrame(
        [(1, "n", "b", "c", "Budget")], "product_id BIGINT, name STRING, brand STRING, category STRING, price_category STRING")
    assert rows(marts.product_sales(tx, active), "product_id", "total_revenue", "num_transactions") == [(1, 4.0, 1)]
    assert marts.sales_summary(tx).count() == 1


def test_facts_are_aggregated_before_the_join(spark):
    tx = facts(spark, ("a", 1, 1, 1, 4.0, D1, "c", "w", "Completed"))
    customers = spark.createDataFrame([(1, "n", "e")], "customer_id INT, name STRING, email STRING")
    text = plan(marts.customer_stats(tx, customers, D1))
    assert text.index("Join") < text.index("HashAggregate")
