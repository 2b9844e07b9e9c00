"""Cleaning rules of the three feeds: bronze rows in, silver rows out.

Rows are validated first and de-duplicated afterwards, so an invalid duplicate never hides a
valid row.  ``inserted_time`` is kept for the merge that follows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve import schemas
from varve.functions import (
    clamp,
    clamp_text,
    days_since,
    ladder,
    order_status,
    present,
    safe_date,
    whole_number,
)
from varve.operators.dedupe import latest_by_key

# Bounds and labels of the derived categories.
SEGMENTS = ((">", 10000, "High Value"), (">", 5000, "Medium Value"))
SEGMENT_DEFAULT = "Low Value"
PRICE_CATEGORIES = ((">", 1000, "Premium"), (">", 100, "Standard"))
PRICE_CATEGORY_DEFAULT = "Budget"
STOCK_STATUSES = (("==", 0, "Out of Stock"), ("<", 10, "Low Stock"), ("<", 50, "Moderate Stock"))
STOCK_STATUS_DEFAULT = "Sufficient Stock"
AGE_RANGE = (18, 100)
RATING_RANGE = (0, 5)


_STAMPS = ("inserted_time", "source_modified")
TRANSACTION_KEYS = ["transaction_id", "transaction_date"]


def _latest(df: DataFrame, keys: Sequence[str], feed: str) -> DataFrame:
    """Newest row per key, cut to the feed's columns before the shuffle."""
    stamps = [c for c in _STAMPS if c in df.columns]
    rows = df.select(*schemas.columns(feed), *stamps)
    return latest_by_key(rows, keys, stamps).drop("source_modified")


def customer_segment(total_purchases: Column | str) -> Column:
    return ladder(total_purchases, SEGMENTS, SEGMENT_DEFAULT)


def price_category(price: Column | str) -> Column:
    return ladder(price, PRICE_CATEGORIES, PRICE_CATEGORY_DEFAULT)


def stock_status(stock_quantity: Column | str) -> Column:
    return ladder(whole_number(stock_quantity), STOCK_STATUSES, STOCK_STATUS_DEFAULT)


def clean_customers(df: DataFrame, as_of: Column | date | None = None) -> DataFrame:
    """Customers with an e-mail, a plausible age and no negative purchases; newest per id."""
    valid = df.filter(
        present("email") & F.col("age").between(*AGE_RANGE) & (F.col("total_purchases") >= 0)
    )
    return _latest(valid, ["customer_id"], schemas.CUSTOMERS_FEED).select(
        *schemas.columns(schemas.CUSTOMERS_FEED),
        customer_segment("total_purchases").alias("customer_segment"),
        days_since("registration_date", as_of).alias("days_since_registration"),
        F.col("inserted_time").alias("last_updated"),
        "inserted_time",
    )


def clean_products(df: DataFrame) -> DataFrame:
    """Products with price, stock and rating in range; the categories see the clamped values."""
    clamped = _latest(df, ["product_id"], schemas.PRODUCTS_FEED).withColumns({
        "price": clamp("price", lo=0),
        "stock_quantity": clamp_text("stock_quantity", lo=0),
        "rating": clamp("rating", *RATING_RANGE),
    })
    return clamped.select(
        *schemas.columns(schemas.PRODUCTS_FEED),
        price_category("price").alias("price_category"),
        stock_status("stock_quantity").alias("stock_status"),
        "inserted_time",
    )


def valid_transactions(df: DataFrame) -> DataFrame:
    """Transactions with a date, a customer and a product; the date as DATE."""
    dated = df.filter(
        present("transaction_date", fold=False)
        & F.col("customer_id").isNotNull()
        & F.col("product_id").isNotNull()
    ).withColumn("transaction_date", safe_date("transaction_date"))
    return dated.filter(F.col("transaction_date").isNotNull())


def clean_transactions(df: DataFrame) -> DataFrame:
    """Transactions with a date, a customer and a product; newest per id and date."""
    latest = _latest(valid_transactions(df), TRANSACTION_KEYS, schemas.TRANSACTIONS_FEED)
    return _clean_facts(latest)


def clean_new_transactions(
    df: DataFrame, batch: str, standing: DataFrame, part: Column, parts: int
) -> DataFrame:
    """Several batches cleaned at once, without what is among the keys of ``standing``.

    Of an id and date the first batch's newest row stays, and the ``batch`` column with it; a
    standing key comes before every batch.  ``part`` gives the partition, of ``parts``, of a row
    by its id and date: one shuffle brings whole rows to where they are compared, and may be
    written.  Null ids equal no standing one.
    """
    # Newest is greatest, so the batch that came first is the greatest negative one.
    first, stands, place = "_first", "_stands", "_part"
    stamps = [c for c in _STAMPS if c in df.columns]
    # What is the same in most rows stands together: shuffled rows shrink better.
    rows = valid_transactions(df).select(
        F.lit(False).alias(stands), (-F.col(batch)).alias(first), *stamps, *schemas.columns(schemas.TRANSACTIONS_FEED)
    )
    known = standing.filter(F.col("transaction_id").isNotNull()).select(F.lit(True).alias(stands), *TRANSACTION_KEYS)
    placed = rows.unionByName(known, allowMissingColumns=True).withColumn(place, part).repartitionById(parts, F.col(place))
    latest = latest_by_key(placed, [place, *TRANSACTION_KEYS], [stands, first, *stamps]).filter(~F.col(stands))
    return _clean_facts(latest.withColumn(batch, -F.col(first)), [batch])


def _clean_facts(latest: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    clamped = latest.withColumns({
        "quantity": clamp("quantity", lo=0),
        "total_amount": clamp("total_amount", lo=0),
    })
    return clamped.select(
        *schemas.columns(schemas.TRANSACTIONS_FEED),
        order_status("quantity", "total_amount").alias("order_status"),
        F.col("inserted_time").alias("last_updated"),
        "inserted_time",
        *kept,
    )
