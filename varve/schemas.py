"""Fixed schemas of the feeds and tables, as DDL strings.

Fixed values: names, types and order of the columns are the contract with the files that land
and with the readers of the tables.
"""

from __future__ import annotations

# Feeds, as they arrive.
CUSTOMERS_FEED = (
    "customer_id INT, name STRING, email STRING, country STRING, customer_type STRING, "
    "registration_date DATE, age INT, gender STRING, total_purchases INT"
)
PRODUCTS_FEED = (
    "brand STRING, category STRING, name STRING, price DOUBLE, product_id BIGINT, "
    "rating DOUBLE, stock_quantity STRING"
)
TRANSACTIONS_FEED = (
    "transaction_id STRING, customer_id INT, product_id INT, quantity INT, "
    "total_amount DOUBLE, transaction_date STRING, payment_method STRING, store_type STRING"
)

# Bronze adds the ingest stamp and the source file's age (the tie-break of dedup).
STAMPS = "inserted_time TIMESTAMP, source_modified TIMESTAMP"
CUSTOMERS_BZ = f"{CUSTOMERS_FEED}, {STAMPS}"
PRODUCTS_BZ = f"{PRODUCTS_FEED}, {STAMPS}"
TRANSACTIONS_BZ = f"{TRANSACTIONS_FEED}, {STAMPS}"

# Silver.
CUSTOMERS_SI = (
    f"{CUSTOMERS_FEED}, customer_segment STRING, days_since_registration INT, "
    "last_updated TIMESTAMP"
)
PRODUCTS_SI = (
    f"{PRODUCTS_FEED}, price_category STRING, stock_status STRING, last_updated TIMESTAMP, "
    "is_active BOOLEAN, start_date TIMESTAMP, end_date TIMESTAMP"
)
TRANSACTIONS_SI = (
    "transaction_id STRING, customer_id INT, product_id INT, quantity INT, "
    "total_amount DOUBLE, transaction_date DATE, payment_method STRING, store_type STRING, "
    "order_status STRING, last_updated TIMESTAMP"
)
# ``facts_lost``: of the versions up to the last one, facts whose customer or product was not known.
META_SI = "table_name STRING, last_inserted_time TIMESTAMP, last_version BIGINT, facts_lost BIGINT"

# Gold: what readers see, views over the states below.
SALES_SUMMARY_GD = (
    "transaction_date DATE, store_type STRING, payment_method STRING, total_sales DOUBLE, "
    "total_transactions BIGINT, avg_order_value DOUBLE, total_quantity_sold BIGINT, "
    "last_updated TIMESTAMP"
)
CUSTOMERS_STATS_GD = (
    "customer_id INT, name STRING, email STRING, first_order_date DATE, last_order_date DATE, "
    "distinct_transaction_dates INT, total_transactions BIGINT, avg_order_value DOUBLE, "
    "total_spent DOUBLE, recency_days INT, last_updated TIMESTAMP"
)
PRODUCT_SALES_GD = (
    "product_id BIGINT, name STRING, brand STRING, category STRING, price_category STRING, "
    "transaction_date DATE, total_quantity_sold BIGINT, total_revenue DOUBLE, "
    "num_transactions BIGINT, last_updated TIMESTAMP"
)
# States: exact sums, how many amounts they hold, and days as bits (month number -> days of it).
SALES_STATE = (
    "transaction_date DATE, store_type STRING, payment_method STRING, spent DECIMAL(37,4), "
    "amounts BIGINT, total_transactions BIGINT, total_quantity_sold BIGINT, last_updated TIMESTAMP"
)
CUSTOMERS_STATE = (
    "customer_id INT, name STRING, email STRING, first_order_date DATE, last_order_date DATE, "
    "order_days MAP<INT,INT>, total_transactions BIGINT, spent DECIMAL(37,4), amounts BIGINT, "
    "recency_days INT, last_updated TIMESTAMP"
)
PRODUCT_STATE = (
    "product_id BIGINT, name STRING, brand STRING, category STRING, price_category STRING, "
    "transaction_date DATE, total_quantity_sold BIGINT, spent DECIMAL(37,4), "
    "num_transactions BIGINT, last_updated TIMESTAMP"
)


def columns(ddl: str) -> list[str]:
    """Column names of a DDL string, in order."""
    return [part.split()[0] for part in ddl.split(",")]
