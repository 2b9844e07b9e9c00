"""Queries over the driver's tables, one per operator or pipeline of the library."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve import schemas
from varve.functions import (
    clamp,
    clamp_text,
    days_since,
    order_status,
    present,
    row_fingerprint,
    safe_date,
)
from varve.operators import (
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
from varve.operators.changes import CHANGE_TYPE, apply_changes, new_images, read_changes, read_changes_after
from varve.plans import marts, pipeline
from varve.plans.clean import (
    clean_customers,
    clean_products,
    clean_transactions,
    customer_segment,
    price_category,
    stock_status,
)
from varve.sources.cursors import write_cursor
from varve.sources.feeds import CUSTOMERS, PRODUCTS, TRANSACTIONS, read_archive, read_feed
from varve.sources.feeds import archived_files as files_in_archive
from varve.sources.tables import BATCH, MONTH, WRITTEN, Settings
from workload import feeds
from workload.workspace import workspace

Query = Callable[[SparkSession, str], DataFrame]

_PRODUCT_FEED = schemas.columns(schemas.PRODUCTS_FEED)
# Yearly batches of transactions.
YEARS = 7


# Projections, filters, rules ----------------------------------------------------------------


def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = feeds.transactions(spark, sf_dir)
    stamped = tx.withColumn("last_updated", F.col("inserted_time")).drop("inserted_time")
    return (
        stamped.withColumnRenamed("customer_id", "transactions_customer_id")
        .withColumn("last_updated", F.col("last_updated").cast("string"))
        .select("transaction_id", "transactions_customer_id", "quantity", "last_updated")
    )


def watermark_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = high_watermark(feeds.read(spark, sf_dir, "orders"), "o_orderdate")
    lines = newer_than(feeds.read(spark, sf_dir, "lineitem"), "l_shipdate", mark)
    return lines.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.col("l_shipdate").cast("date").alias("ship_date"),
    )


def null_token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.customers(spark, sf_dir).filter(present("email")).select("customer_id", "email")


def null_date_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = feeds.transactions(spark, sf_dir)
    return tx.filter(present("transaction_date", fold=False)).select("transaction_id", "transaction_date")


def range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    plausible = F.col("age").between(18, 100) & (F.col("total_purchases") >= 0)
    return feeds.customers(spark, sf_dir).filter(plausible).select("customer_id", "age", "total_purchases")


def key_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = feeds.transactions(spark, sf_dir)
    return tx.filter(F.col("customer_id").isNotNull() & F.col("product_id").isNotNull()).select(
        "transaction_id", "customer_id", "product_id"
    )


def clamp_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.transactions(spark, sf_dir).select(
        "transaction_id",
        clamp("quantity", lo=0).alias("quantity"),
        clamp("total_amount", lo=0).alias("total_amount"),
    )


def clamp_product_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.products(spark, sf_dir, 1).select(
        "product_id", clamp("price", lo=0).alias("price"), clamp("rating", 0, 5).alias("rating")
    )


def clamp_text_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.products(spark, sf_dir, 1).select(
        "product_id", clamp_text("stock_quantity", lo=0).alias("stock_quantity")
    )


def segment_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.customers(spark, sf_dir).select(
        "customer_id", customer_segment("total_purchases").alias("customer_segment")
    )


def price_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.products(spark, sf_dir, 1).select(
        "product_id", price_category(clamp("price", lo=0)).alias("price_category")
    )


def stock_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.products(spark, sf_dir, 1).select(
        "product_id", stock_status(clamp_text("stock_quantity", lo=0)).alias("stock_status")
    )


def order_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.transactions(spark, sf_dir).select(
        "transaction_id",
        order_status(clamp("quantity", lo=0), clamp("total_amount", lo=0)).alias("order_status"),
    )


def safe_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.transactions(spark, sf_dir).select(
        "transaction_id", safe_date("transaction_date").alias("transaction_date")
    )


def days_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.customers(spark, sf_dir).select(
        "customer_id", days_since("registration_date", feeds.AS_OF).alias("days_since_registration")
    )


def row_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.customers(spark, sf_dir).select(
        "customer_id",
        row_fingerprint("customer_id", "name", "email", "country", "gender", "age").alias("fingerprint"),
    )


def temp_view_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned facts handed to SQL by a temporary view."""
    clean_transactions(feeds.transactions(spark, sf_dir)).createOrReplaceTempView("varve_facts")
    return spark.sql(
        "SELECT store_type, order_status, count(*) AS facts, sum(quantity) AS quantity "
        "FROM varve_facts GROUP BY store_type, order_status"
    )


# Dedup, joins, set operations ---------------------------------------------------------------


def latest_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = feeds.read(spark, sf_dir, "lineitem")
    latest = latest_by_key(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate"])
    return latest.withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


def anti_join_changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = rows_not_in(
        feeds.products(spark, sf_dir, 1), feeds.products(spark, sf_dir, 0), _PRODUCT_FEED
    )
    return changed.select(*_PRODUCT_FEED)


def inner_join_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = clean_transactions(feeds.transactions(spark, sf_dir))
    known = clean_customers(feeds.customers(spark, sf_dir), feeds.AS_OF)
    return tx.join(known.select("customer_id", "name", "email"), "customer_id").select(
        "transaction_id", "customer_id", "name", "email", "total_amount"
    )


def _active_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _product_history(spark, sf_dir, 2).filter("is_active")


def inner_join_active_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = clean_transactions(feeds.transactions(spark, sf_dir))
    active = _active_products(spark, sf_dir).select("product_id", "name", "brand", "price_category")
    return tx.join(active, "product_id").select(
        "transaction_id", "product_id", "name", "brand", "price_category", "quantity"
    )


def union_all_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed products keyed by id, and those already known once more under a null key."""
    before, after = (clean_products(feeds.products(spark, sf_dir, n)) for n in (0, 1))
    changed = rows_not_in(after, before, _PRODUCT_FEED).select(*_PRODUCT_FEED)
    known = changed.join(before.select("product_id"), "product_id", "left_semi")
    return changed.withColumn("merge_key", F.col("product_id")).unionByName(
        known.withColumn("merge_key", F.lit(None).cast("bigint"))
    ).select("merge_key", "product_id", "price", "rating")


# Cleaning -----------------------------------------------------------------------------------


def cleaned_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = clean_customers(feeds.customers(spark, sf_dir), feeds.AS_OF)
    return clean.drop("inserted_time").withColumn("last_updated", F.col("last_updated").cast("string"))


def cleaned_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_products(feeds.products(spark, sf_dir, 1)).drop("inserted_time")


def cleaned_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = clean_transactions(feeds.transactions(spark, sf_dir))
    return clean.drop("inserted_time").withColumn("last_updated", F.col("last_updated").cast("string"))


# Merges -------------------------------------------------------------------------------------


def _customer_upsert(spark: SparkSession, sf_dir: str):
    target = clean_customers(feeds.customers(spark, sf_dir), feeds.AS_OF).drop("inserted_time")
    source = clean_customers(feeds.customers_later(spark, sf_dir), feeds.AS_OF)
    return target, upsert(target, source, ["customer_id"])


_CUSTOMER_OUT = ["customer_id", "name", "email", "total_purchases", "customer_segment",
                 "days_since_registration"]


def upsert_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customer_upsert(spark, sf_dir)[1].rows.select(*_CUSTOMER_OUT)


def upsert_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _customer_upsert(spark, sf_dir)[1].changes
    return changes.select(F.col(CHANGE_TYPE).alias("change_type"), *_CUSTOMER_OUT)


def replayed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applying the changes to the old table gives the new one."""
    target, merged = _customer_upsert(spark, sf_dir)
    return apply_changes(target, merged.changes, ["customer_id"]).select(*_CUSTOMER_OUT)


def changed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as they are after the merge, inserts and updates only."""
    return new_images(_customer_upsert(spark, sf_dir)[1].changes).select(*_CUSTOMER_OUT)


def insert_only_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts arrive again; only those not yet in the table are to be appended."""
    facts = clean_transactions(feeds.transactions(spark, sf_dir))
    present_facts = facts.filter(F.col("transaction_date") < F.lit("1999-01-01").cast("date"))
    fresh = insert_only(present_facts, facts, ["transaction_id", "transaction_date"])
    return fresh.select("transaction_id", "transaction_date", "order_status")


def _empty_history(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.PRODUCTS_SI)


def _product_history(spark: SparkSession, sf_dir: str, loads: int) -> DataFrame:
    history = _empty_history(spark)
    for load in range(loads):
        batch = clean_products(feeds.products(spark, sf_dir, load))
        history = scd2_merge(history, batch, "product_id").rows
    return history


def _history_out(history: DataFrame) -> DataFrame:
    return history.select(
        "product_id", "price", "rating", "stock_quantity", "price_category", "stock_status", "is_active",
        *[F.col(c).cast("string").alias(c) for c in ("start_date", "end_date", "last_updated")],
    )


def scd2_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history_out(_product_history(spark, sf_dir, 2))


def scd2_revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third load goes back to the first one's values: a version of its own."""
    return _history_out(_product_history(spark, sf_dir, 3))


def merge_when_price_differs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and ratings of the second load, only where the price differs; a null price never does."""
    before = clean_products(feeds.products(spark, sf_dir, 0)).select("product_id", "price", "rating")
    spoiled = F.when(F.col("product_id") % 5 == 0, None).otherwise(F.col("price"))
    after = clean_products(feeds.products(spark, sf_dir, 1)).withColumn("price", spoiled)
    values = {c: new(c) for c in ("price", "rating")}
    merged = merge(
        before, after, ["product_id"], update=values, insert={"product_id": new("product_id"), **values},
        when=old("price") != new("price"),
    )
    return merged.rows


def scd2_change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _product_history(spark, sf_dir, 1)
    batch = clean_products(feeds.products(spark, sf_dir, 1))
    changes = scd2_merge(history, batch, "product_id").changes
    return changes.select(
        F.col(CHANGE_TYPE).alias("change_type"), "product_id", "price", "rating", "is_active",
        F.col("end_date").cast("string").alias("end_date"),
    )


def advance_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cursor per event type, seeded at the beginning of time and moved to its newest event."""
    events = feeds.read(spark, sf_dir, "events")
    seeds = events.select(F.col("event_type").alias("table_name")).distinct().withColumn(
        "last_inserted_time", F.lit("1900-01-01").cast("timestamp_ntz")
    )
    newest = events.groupBy(F.col("event_type").alias("table_name")).agg(
        F.max("ts").alias("last_inserted_time")
    )
    return upsert(seeds, newest, ["table_name"]).rows.withColumn(
        "last_inserted_time", F.date_format("last_inserted_time", "yyyy-MM-dd HH:mm:ss")
    )


# Marts, one shot ----------------------------------------------------------------------------


def _stats_out(df: DataFrame) -> DataFrame:
    return df.drop("last_updated")


def sales_summary_one_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats_out(marts.sales_summary(clean_transactions(feeds.transactions(spark, sf_dir))))


def customer_stats_one_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = clean_transactions(feeds.transactions(spark, sf_dir))
    customers = clean_customers(feeds.customers(spark, sf_dir), feeds.AS_OF)
    return _stats_out(marts.customer_stats(tx, customers, feeds.AS_OF))


def product_sales_one_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = clean_transactions(feeds.transactions(spark, sf_dir))
    return _stats_out(marts.product_sales(tx, _active_products(spark, sf_dir)))


# Marts, batch by batch through the published tables -----------------------------------------


def _landed(
    spark: SparkSession, sf_dir: str, change: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> Settings:
    """An environment whose bronze transactions hold one batch per year, after a ``change`` if any."""
    settings = workspace(spark)
    pipeline.run_setup(spark, settings)
    bronze = settings.table("bronze", "transactions_bz")
    path = f"{settings.layer_path('bronze')}/transactions_bz"
    rows = _timed(change(feeds.transactions(spark, sf_dir)))
    columns = spark.table(bronze).columns
    # The join's tasks write their part of every batch: no second shuffle of whole rows.
    rows.select(*columns).write.partitionBy(BATCH).mode("append").options(**WRITTEN).parquet(path)
    spark.sql(f"ALTER TABLE {bronze} RECOVER PARTITIONS")
    return settings


def change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed of the fact table, from a cursor in the middle."""
    settings = _landed(spark, sf_dir)
    pipeline.load_transactions(spark, settings)
    changes = read_changes(spark, settings.table("silver", "transactions_si"), since=2)
    return changes.select(
        "transaction_id", "transaction_date", F.col("_commit_version").alias("commit_version"),
        F.col(CHANGE_TYPE).alias("change_type"),
    )


def changes_since_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed of the fact table after a time; every yearly batch commits at the new year after it."""
    settings = _landed(spark, sf_dir)
    bronze = spark.table(settings.table("bronze", "transactions_bz"))
    for version in range(YEARS):
        committed = F.lit(datetime(feeds.FIRST_YEAR + version + 1, 1, 1))
        pipeline.apply_transactions(spark, settings, bronze.filter(F.col(BATCH) == version), version, committed)
    changes = read_changes_after(spark, settings.table("silver", "transactions_si"), datetime(1998, 6, 1))
    return changes.select(
        "transaction_id", F.col("_commit_version").alias("commit_version"),
        F.col("_commit_timestamp").cast("string").alias("committed"),
    )


def insert_only_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch arrives again, after all of them, under a number of its own: facts stay where they were."""
    again = F.explode(F.array(F.col(BATCH), F.col(BATCH) + YEARS))
    settings = _landed(spark, sf_dir, lambda rows: rows.withColumn(BATCH, again))
    pipeline.load_transactions(spark, settings)
    facts = spark.table(settings.table("silver", "transactions_si"))
    return facts.select("transaction_id", "transaction_date", F.col("_commit_version").alias("commit_version"))


def empty_batch_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch without a valid row, before and after which gold runs."""
    spoiled = F.when(F.col(BATCH) == 3, "null").otherwise(F.col("transaction_date"))
    settings = _landed(spark, sf_dir, lambda rows: rows.withColumn("transaction_date", spoiled))
    bronze = spark.table(settings.table("bronze", "transactions_bz"))
    meta = settings.table("silver", "meta_si")
    for versions in (range(3), range(3, 4), range(4, YEARS)):
        for version in versions:
            pipeline.apply_transactions(spark, settings, bronze.filter(F.col(BATCH) == version), version)
        write_cursor(spark, meta, "transactions_si", versions[-1])
        pipeline.update_sales_summary(spark, settings)
    cursor = spark.table(meta).filter("table_name = 'sales_summary_gd'").select("last_version")
    return _stats_out(spark.table(settings.table("gold", "sales_summary_gd"))).join(F.broadcast(cursor))


def cursor_after_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cursors after facts and one mart were brought up to date."""
    settings = _landed(spark, sf_dir)
    pipeline.load_transactions(spark, settings)
    pipeline.update_sales_summary(spark, settings)
    return spark.table(settings.table("silver", "meta_si")).select("table_name", "last_version")


def lost_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each mart had to leave out: facts whose customer or product is not known."""
    settings = _landed(spark, sf_dir)
    pipeline.apply_customers(spark, settings, _timed(feeds.customers(spark, sf_dir)), 0, feeds.AS_OF)
    pipeline.apply_products(spark, settings, _timed(feeds.products(spark, sf_dir, 0)), 0)
    pipeline.load_transactions(spark, settings)
    pipeline.run_gold(spark, settings, feeds.AS_OF)
    meta = spark.table(settings.table("silver", "meta_si")).filter(F.col("table_name").isin(*pipeline.GOLD))
    return meta.select("table_name", "last_version", "facts_lost")


def sales_summary_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = _landed(spark, sf_dir)
    pipeline.load_transactions(spark, settings)
    pipeline.update_sales_summary(spark, settings)
    return _stats_out(spark.table(settings.table("gold", "sales_summary_gd")))


def customer_stats_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = _landed(spark, sf_dir)
    pipeline.apply_customers(spark, settings, _timed(feeds.customers(spark, sf_dir)), 0, feeds.AS_OF)
    pipeline.load_transactions(spark, settings)
    pipeline.update_customer_stats(spark, settings, feeds.AS_OF)
    return _stats_out(spark.table(settings.table("gold", "customers_stats_gd")))


def product_sales_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = _landed(spark, sf_dir)
    for load in (0, 1):
        pipeline.apply_products(spark, settings, _timed(feeds.products(spark, sf_dir, load)), load)
    pipeline.load_transactions(spark, settings)
    pipeline.update_product_sales(spark, settings)
    return _stats_out(spark.table(settings.table("gold", "product_sales_summary_gd"))).drop(MONTH)


def published_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three product loads through the published tables: active rows plus logged closed rows."""
    settings = workspace(spark)
    pipeline.run_setup(spark, settings)
    for load in (0, 1, 2):
        pipeline.apply_products(spark, settings, _timed(feeds.products(spark, sf_dir, load)), load)
    return _history_out(spark.table(settings.table("silver", "products_si")))


def published_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two customer loads through the published tables."""
    settings = workspace(spark)
    pipeline.run_setup(spark, settings)
    for version, load in enumerate((feeds.customers, feeds.customers_later)):
        pipeline.apply_customers(spark, settings, _timed(load(spark, sf_dir)), version, feeds.AS_OF)
    return spark.table(settings.table("silver", "customers_si")).select(*_CUSTOMER_OUT)


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn("source_modified", F.lit(None).cast("timestamp"))


# From files ---------------------------------------------------------------------------------

# Products per landed document: a document is read by one task, so its size is fixed.
_PER_DOCUMENT = 20_000


def _land_transactions(spark: SparkSession, sf_dir: str, settings: Settings) -> None:
    columns = schemas.columns(schemas.TRANSACTIONS_FEED)
    feeds.transactions(spark, sf_dir).select(*columns).write.mode("append").json(
        settings.landing_path("transactions"), compression="gzip"
    )


def _land_products(spark: SparkSession, sf_dir: str, settings: Settings) -> None:
    documents = (
        feeds.products(spark, sf_dir, 1)
        .groupBy(F.floor(F.col("product_id") / _PER_DOCUMENT).alias("document"))
        .agg(F.to_json(F.collect_list(F.struct(*_PRODUCT_FEED))).alias("value"))
    )
    documents.write.mode("append").partitionBy("document").text(settings.landing_path("products"))


def _land_customers(spark: SparkSession, sf_dir: str, settings: Settings) -> None:
    columns = schemas.columns(schemas.CUSTOMERS_FEED)
    exact = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    feeds.customers(spark, sf_dir).select(*columns).write.mode("append").options(**exact).csv(
        settings.landing_path("customers")
    )


def json_lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = workspace(spark)
    _land_transactions(spark, sf_dir, settings)
    scan = read_feed(spark, TRANSACTIONS, settings.landing_path("transactions"))
    return scan.select(*schemas.columns(schemas.TRANSACTIONS_FEED))


def json_document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = workspace(spark)
    _land_products(spark, sf_dir, settings)
    return read_feed(spark, PRODUCTS, settings.landing_path("products")).select(*_PRODUCT_FEED)


def csv_stream_to_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = workspace(spark)
    pipeline.run_setup(spark, settings)
    _land_customers(spark, sf_dir, settings)
    pipeline.run_bronze(spark, settings, feeds=("customers",))
    bronze = spark.table(settings.table("bronze", "customers_bz"))
    return bronze.select(*schemas.columns(schemas.CUSTOMERS_FEED), BATCH)


def bronze_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents as a stream to bronze: one ingest stamp for all rows of the batch."""
    settings = workspace(spark)
    pipeline.run_setup(spark, settings)
    _land_products(spark, sf_dir, settings)
    pipeline.run_bronze(spark, settings, feeds=("products",))
    bronze = spark.table(settings.table("bronze", "products_bz"))
    stamps = bronze.agg(F.count_distinct("inserted_time").alias("stamps"))
    return bronze.select(*_PRODUCT_FEED, BATCH).join(F.broadcast(stamps))


def archived_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files consumed by one batch, read back from the archive after the next; is each as long as it says?"""
    settings = workspace(spark)
    pipeline.run_setup(spark, settings)
    _land_customers(spark, sf_dir, settings)
    pipeline.run_bronze(spark, settings, feeds=("customers",))
    _land_customers(spark, sf_dir, settings)
    pipeline.run_bronze(spark, settings, feeds=("customers",))
    archive = settings.archive_path("customers")
    sizes = files_in_archive(spark, archive).select(F.col("path").alias("source_file"), "length")
    rows = read_archive(spark, CUSTOMERS, archive).join(sizes, "source_file")
    return rows.select("customer_id", "name", "email", (F.col("length") == F.col("source_length")).alias("same_length"))


def files_to_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV, JSON and JSON lines through all layers to customer statistics."""
    settings = workspace(spark)
    pipeline.run_setup(spark, settings)
    _land_customers(spark, sf_dir, settings)
    _land_products(spark, sf_dir, settings)
    _land_transactions(spark, sf_dir, settings)
    pipeline.run_bronze(spark, settings)
    pipeline.run_silver(spark, settings, feeds.AS_OF)
    pipeline.run_gold(spark, settings, feeds.AS_OF)
    return _stats_out(spark.table(settings.table("gold", "customers_stats_gd")))


QUERIES: dict[str, Query] = {
    "scan_project": scan_project,
    "watermark_filter": watermark_filter,
    "null_token_filter": null_token_filter,
    "null_date_filter": null_date_filter,
    "range_filter": range_filter,
    "key_filter": key_filter,
    "clamp_columns": clamp_columns,
    "clamp_product_columns": clamp_product_columns,
    "clamp_text_number": clamp_text_number,
    "segment_ladder": segment_ladder,
    "price_category": price_categories,
    "stock_status": stock_statuses,
    "order_status": order_statuses,
    "safe_to_date": safe_to_date,
    "days_between": days_between,
    "row_fingerprint": row_fingerprints,
    "temp_view_sql": temp_view_sql,
    "latest_by_key": latest_by_line,
    "anti_join_changed_rows": anti_join_changed_rows,
    "inner_join_customers": inner_join_customers,
    "inner_join_active_products": inner_join_active_products,
    "union_all_staged": union_all_staged,
    "clean_customers": cleaned_customers,
    "clean_products": cleaned_products,
    "clean_transactions": cleaned_transactions,
    "upsert": upsert_customers,
    "upsert_changes": upsert_changes,
    "changed_images": changed_images,
    "replayed_changes": replayed_changes,
    "insert_only_merge": insert_only_merge,
    "scd2_two_batches": scd2_two_batches,
    "scd2_revert": scd2_revert,
    "scd2_change_rows": scd2_change_rows,
    "merge_when_price_differs": merge_when_price_differs,
    "advance_cursor": advance_cursor,
    "cursor_after_run": cursor_after_run,
    "changes_since_time": changes_since_time,
    "insert_only_published": insert_only_published,
    "empty_batch_between": empty_batch_between,
    "lost_facts": lost_facts,
    "bronze_products": bronze_products,
    "archived_files": archived_files,
    "sales_summary_one_shot": sales_summary_one_shot,
    "customer_stats_one_shot": customer_stats_one_shot,
    "product_sales_one_shot": product_sales_one_shot,
    "change_rows": change_rows,
    "sales_summary_incremental": sales_summary_incremental,
    "customer_stats_incremental": customer_stats_incremental,
    "product_sales_incremental": product_sales_incremental,
    "published_history": published_history,
    "published_customers": published_customers,
    "json_lines_scan": json_lines_scan,
    "json_document_scan": json_document_scan,
    "csv_stream_to_bronze": csv_stream_to_bronze,
    "files_to_gold": files_to_gold,
}
