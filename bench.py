"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and then ``$BENCH_RUNS`` times (default 3); the median counts.
``merge`` steps time one batch against tables that already exist.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.functions import money
from varve.operators import insert_only, scd2_merge, upsert
from varve.plans import marts
from varve.plans.clean import clean_customers, clean_products, clean_transactions
from varve.session import build_session
from workload import feeds
from workload.queries import QUERIES
from workload.workspace import workspace

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

ONE_SHOT = (
    "clean_transactions",
    "latest_by_key",
    "inner_join_customers",
    "inner_join_active_products",
    "sales_summary_one_shot",
    "customer_stats_one_shot",
    "product_sales_one_shot",
    "scd2_two_batches",
    "upsert",
)


def consume(df: DataFrame) -> None:
    """Compute every row and column, keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def stored(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return spark.read.parquet(path)


def one_percent(c: str):
    return F.pmod(F.xxhash64(c), F.lit(100)) == 0


def batch_steps(spark: SparkSession) -> dict[str, Callable[[], None]]:
    """One late batch against stored tables: the steady state of an incremental pipeline."""
    root = workspace(spark).root
    facts = stored(
        spark,
        clean_transactions(feeds.transactions(spark, SF_DIR)).withColumn("year", F.year("transaction_date")),
        f"{root}/facts",
    )
    before, last = facts.filter("year < 2001").drop("year"), facts.filter("year = 2001").drop("year")
    customers = stored(
        spark, clean_customers(feeds.customers(spark, SF_DIR), feeds.AS_OF), f"{root}/customers"
    )
    history = stored(
        spark,
        clean_products(feeds.products(spark, SF_DIR, 1)).select(
            "*",
            F.col("inserted_time").alias("last_updated"),
            F.lit(True).alias("is_active"),
            F.col("inserted_time").alias("start_date"),
            F.lit(None).cast("timestamp").alias("end_date"),
        ).drop("inserted_time"),
        f"{root}/history",
    )
    moved = history.filter(one_percent("product_id")).withColumn("price", F.col("price") + 1).withColumn(
        "inserted_time", F.lit(feeds.LOADED[2])
    )
    sales = stored(spark, marts.sales_state(before), f"{root}/sales")

    def stats_of(tx: DataFrame) -> DataFrame:
        return marts.customer_state(marts.with_customer(marts.customer_totals(tx), customers), feeds.AS_OF)

    def sold(tx: DataFrame) -> DataFrame:
        return marts.product_state(marts.with_product(marts.product_days(tx), history))

    stats = stored(spark, stats_of(before), f"{root}/stats")
    by_product = stored(spark, sold(before), f"{root}/products")
    renamed = customers.filter(one_percent("customer_id")).withColumn("name", F.upper("name"))
    resent = before.filter(one_percent("transaction_id")).unionByName(last)

    return {
        "batch_sales_summary": lambda: consume(marts.fold_sales(sales, marts.sales_state(last)).rows),
        "batch_customer_stats": lambda: consume(marts.fold_customers(stats, stats_of(last), feeds.AS_OF).rows),
        "batch_product_sales": lambda: consume(marts.fold_products(by_product, sold(last)).rows),
        "batch_scd2_1pct": lambda: consume(scd2_merge(history, moved, "product_id").rows),
        "batch_upsert_1pct": lambda: consume(
            upsert(customers, renamed, ["customer_id"], check_unique=False).rows
        ),
        "batch_insert_only": lambda: consume(
            insert_only(before, resent, ["transaction_id", "transaction_date"])
        ),
        "money_total": lambda: consume(facts.agg(money.total("total_amount").alias("total"))),
    }


def median_seconds(run: Callable[[], None]) -> float:
    run()
    times = []
    for _ in range(RUNS):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 3)


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        {
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    steps: dict[str, Callable[[], None]] = {
        name: (lambda q=QUERIES[name]: consume(q(spark, SF_DIR))) for name in ONE_SHOT
    }
    steps.update(batch_steps(spark))
    seconds = {}
    for name, step in steps.items():
        seconds[name] = median_seconds(step)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    # Seven yearly batches through the published tables, catalog and cursors included.
    start = time.perf_counter()
    consume(QUERIES["sales_summary_incremental"](spark, SF_DIR))
    seconds["sales_summary_incremental_7_batches"] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
