"""Operators against plain Python on random small batches."""

import random
from datetime import date, datetime, timedelta

import pytest

from varve.operators import insert_only, latest_by_key, scd2_merge, upsert
from varve.plans import marts

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("seed", range(3))
def test_history(spark, rows, seed):
    """Each batch closes what differs and opens a new version; values may be null."""
    rng = random.Random(seed)
    schema = "product_id BIGINT, price DOUBLE, name STRING, inserted_time TIMESTAMP"
    history = spark.createDataFrame(
        [], "product_id BIGINT, price DOUBLE, name STRING, last_updated TIMESTAMP, is_active BOOLEAN, "
            "start_date TIMESTAMP, end_date TIMESTAMP")
    expected = []
    for step in range(3):
        at = T0 + timedelta(days=step)
        batch = [(k, rng.choice([None, 1.0, 2.0]), rng.choice([None, "a", "b"]), at)
                 for k in range(12) if rng.random() < 0.7]
        history = scd2_merge(history, spark.createDataFrame(batch, schema), "product_id").rows
        for key, price, name, stamp in batch:
            active = next((v for v in expected if v["key"] == key and v["end"] is None), None)
            if active and (active["price"], active["name"]) == (price, name):
                continue
            if active:
                active["end"] = stamp
            expected.append({"key": key, "price": price, "name": name, "start": stamp, "end": None})
    got = rows(history, "product_id", "price", "name", "start_date", "end_date", "is_active")
    assert got == sorted(
        ((v["key"], v["price"], v["name"], v["start"], v["end"], v["end"] is None) for v in expected), key=repr
    )


@pytest.mark.parametrize("seed", range(3))
def test_upsert_and_insert_only(spark, rows, seed):
    rng = random.Random(seed)
    schema = "k INT, day INT, v STRING"

    def frame(tag):
        keys = {(rng.choice([None, *range(6)]), rng.randrange(3)) for _ in range(12)}
        return [(k, d, f"{tag}{k}{d}") for k, d in keys]

    target, source = frame("t"), frame("s")
    t, s = (spark.createDataFrame(x, schema) for x in (target, source))
    known = {(k, d) for k, d, _ in target if k is not None}
    fresh = [r for r in source if (r[0], r[1]) not in known]
    assert rows(insert_only(t, s, ["k", "day"])) == sorted(fresh, key=repr)
    replaced = {(k, d) for k, d, _ in source if k is not None}
    kept = [r for r in target if (r[0], r[1]) not in replaced]
    assert rows(upsert(t, s, ["k", "day"]).rows) == sorted(kept + source, key=repr)


def test_latest_by_key(spark, rows):
    rng = random.Random(5)
    data = [(rng.choice([None, *range(8)]), rng.randrange(4), rng.choice([None, "a", "b"])) for _ in range(300)]
    best = {}
    for k, at, v in data:
        rank = (at, v is not None, v or "")
        if k not in best or rank > best[k][0]:
            best[k] = (rank, (k, at, v))
    got = latest_by_key(spark.createDataFrame(data, "k INT, at INT, v STRING"), ["k"], ["at"])
    assert rows(got) == sorted((row for _, row in best.values()), key=repr)


def test_marts_with_a_hot_customer_product_and_day(spark, rows):
    """A third of all facts share one customer, one product and one day."""
    rng = random.Random(9)
    facts = []
    for i in range(3000):
        hot = i % 3 == 0
        facts.append((
            f"t{i}", 1 if hot else rng.randrange(2, 40), 1 if hot else rng.randrange(2, 40), rng.randrange(4),
            rng.randrange(100_000) / 100, date(2024, 1, 1) + timedelta(days=0 if hot else rng.randrange(60)),
            rng.choice(["card", None]), "web", "Completed" if rng.random() < 0.9 else "Cancelled",
        ))
    schema = ("transaction_id STRING, customer_id INT, product_id INT, quantity INT, total_amount DOUBLE, "
              "transaction_date DATE, payment_method STRING, store_type STRING, order_status STRING")
    tx = spark.createDataFrame(facts, schema)
    customers = spark.createDataFrame(
        [(i, f"n{i}", f"e{i}") for i in range(1, 35)], "customer_id INT, name STRING, email STRING")
    active = spark.createDataFrame(
        [(i, f"p{i}", "b", None, "Budget") for i in range(1, 35)],
        "product_id BIGINT, name STRING, brand STRING, category STRING, price_category STRING")

    def cents(items):
        return sum(round(f[4] * 100) for f in items)

    counted = [f for f in facts if f[8] != "Cancelled"]
    stats = []
    for c in range(1, 35):
        mine = [f for f in counted if f[1] == c]
        if mine:
            stats.append((c, len({f[5] for f in mine}), len(mine), cents(mine) / 100,
                          (2 * cents(mine) + len(mine)) // (2 * len(mine)) / 100))
    assert rows(marts.customer_stats(tx, customers, date(2024, 4, 1)), "customer_id", "distinct_transaction_dates",
                "total_transactions", "total_spent", "avg_order_value") == sorted(stats, key=repr)
    sold = {}
    for f in facts:
        if f[2] < 35:
            sold.setdefault((f[2], f[5]), []).append(f)
    assert rows(marts.product_sales(tx, active), "product_id", "transaction_date", "total_quantity_sold",
                "total_revenue", "num_transactions") == sorted(
        ((p, d, sum(f[3] for f in fs), cents(fs) / 100, len(fs)) for (p, d), fs in sold.items()), key=repr)
