"""The same queries in SQL for DuckDB, written independently of the operators.

Money is summed in whole cents; timestamps leave as text.
"""

from __future__ import annotations

AS_OF = "DATE '2002-01-01'"

_TX = """
tx AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS transaction_id,
         CASE WHEN l_discount = 0.1 THEN NULL ELSE CAST(o_custkey AS INTEGER) END AS customer_id,
         CASE WHEN l_discount = 0.0 AND l_tax = 0.08 THEN NULL ELSE CAST(l_partkey AS INTEGER) END AS product_id,
         CAST(l_quantity - 5 AS INTEGER) AS quantity,
         CASE WHEN l_tax = 0.07 THEN -l_extendedprice ELSE l_extendedprice END AS total_amount,
         CASE WHEN l_tax = 0.0 AND l_discount = 0.09 THEN 'null'
              WHEN l_tax = 0.0 AND l_discount = 0.08 THEN '2024-13-40'
              ELSE strftime(l_shipdate, '%Y-%m-%d') END AS transaction_date,
         CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS payment_method,
         l_returnflag AS store_type,
         CAST(year(l_shipdate) AS VARCHAR) || '-12-31 00:00:00' AS inserted_time,
         year(l_shipdate) - 1995 AS batch_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

_CLEAN_TX = _TX + """,
facts AS (
  SELECT transaction_id, customer_id, product_id,
         CASE WHEN quantity < 0 THEN 0 ELSE quantity END AS quantity,
         CASE WHEN total_amount < 0 THEN 0 ELSE total_amount END AS total_amount,
         CAST(round(100 * CASE WHEN total_amount < 0 THEN 0 ELSE total_amount END) AS BIGINT) AS cents,
         CAST(transaction_date AS DATE) AS transaction_date, payment_method, store_type,
         CASE WHEN quantity <= 0 OR total_amount <= 0 THEN 'Cancelled' ELSE 'Completed' END AS order_status,
         inserted_time AS last_updated, batch_id
  FROM tx
  WHERE transaction_date NOT IN ('null', '2024-13-40')
    AND customer_id IS NOT NULL AND product_id IS NOT NULL
)"""

_CUSTOMERS = """
customer_feed AS (
  SELECT CAST(c_custkey AS INTEGER) AS customer_id, c_name AS name,
         CASE c_nationkey WHEN 0 THEN NULL WHEN 1 THEN ' NULL ' WHEN 2 THEN ''
              ELSE lower(c_name) || '@example.com' END AS email,
         'N' || c_nationkey AS country, c_mktsegment AS customer_type,
         CAST(DATE '1990-01-01' + c_nationkey * 30 AS DATE) AS registration_date,
         c_nationkey * 4 + 10 AS age, CAST(NULL AS VARCHAR) AS gender,
         CAST(floor(c_acctbal * 2) AS INTEGER) AS total_purchases
  FROM customer
),
customers AS (
  SELECT *,
         CASE WHEN total_purchases > 10000 THEN 'High Value'
              WHEN total_purchases > 5000 THEN 'Medium Value' ELSE 'Low Value' END AS customer_segment,
         CAST(DATE '2002-01-01' - registration_date AS INTEGER) AS days_since_registration
  FROM customer_feed
  WHERE email IS NOT NULL AND email <> ' NULL ' AND age BETWEEN 18 AND 100 AND total_purchases >= 0
)"""

_LATER = """
later AS (
  SELECT customer_id, name || '*' AS name, lower(name) || '@example.org' AS email,
         CAST(n * 1000 AS INTEGER) AS total_purchases,
         CASE WHEN n > 10 THEN 'High Value' WHEN n > 5 THEN 'Medium Value' ELSE 'Low Value' END AS customer_segment,
         CAST(DATE '2002-01-01' - DATE '1990-01-01' AS INTEGER) AS days_since_registration
  FROM customer_feed JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = customer_id
)"""

_PRODUCT_COLUMNS = """p_brand AS brand, p_type AS category, p_name AS name, p_partkey AS product_id,
         CASE p_size WHEN 13 THEN 'abc' WHEN 14 THEN '3.7' WHEN 15 THEN NULL WHEN 16 THEN '-0.5'
              ELSE CAST(p_size * 2 - 20 AS VARCHAR) END AS stock_quantity,
         p_retailprice * (p_size - 10) / 10 AS price0, CAST(p_size AS DOUBLE) / 5 - 1 AS rating0, p_size"""

_PRODUCTS = f"""
parts AS (SELECT {_PRODUCT_COLUMNS} FROM part),
loads AS (
  SELECT 0 AS load, '2001-01-01 00:00:00' AS loaded_at, price0 AS price, rating0 AS rating, parts.* FROM parts
  WHERE brand <> 'Brand#1'
  UNION ALL
  SELECT 1, '2001-02-01 00:00:00', CASE WHEN p_size > 25 THEN price0 * 2 ELSE price0 END,
         CASE WHEN p_size BETWEEN 20 AND 25 THEN rating0 - 0.5 ELSE rating0 END, parts.* FROM parts
  UNION ALL
  SELECT 2, '2001-03-01 00:00:00', price0, rating0, parts.* FROM parts
),
products AS (
  SELECT load, loaded_at, product_id, brand, category, name,
         CASE WHEN price < 0 THEN 0 ELSE price END AS price,
         CASE WHEN rating < 0 THEN 0 WHEN rating > 5 THEN 5 ELSE rating END AS rating,
         CASE WHEN p_size < 10 THEN '0' ELSE stock_quantity END AS stock_quantity,
         CASE WHEN price > 1000 THEN 'Premium' WHEN price > 100 THEN 'Standard' ELSE 'Budget' END AS price_category,
         CASE WHEN p_size <= 10 OR p_size = 16 THEN 'Out of Stock' WHEN p_size IN (13, 15) THEN 'Sufficient Stock'
              WHEN p_size = 14 OR p_size < 15 THEN 'Low Stock'
              WHEN p_size < 35 THEN 'Moderate Stock' ELSE 'Sufficient Stock' END AS stock_status
  FROM loads
)"""


def _history(loads: int) -> str:
    """Versions start where a tracked value differs from the load before."""
    tracked = ("brand", "category", "name", "price", "rating", "stock_quantity", "price_category", "stock_status")
    moved = " OR ".join(f"{c} IS DISTINCT FROM lag({c}) OVER w" for c in tracked)
    return _PRODUCTS + f""",
marked AS (
  SELECT *, lag(load) OVER w IS NULL OR {moved} AS starts
  FROM products WHERE load < {loads} WINDOW w AS (PARTITION BY product_id ORDER BY load)
),
history AS (
  SELECT *, loaded_at AS start_date, lead(loaded_at) OVER (PARTITION BY product_id ORDER BY load) AS end_date
  FROM marked WHERE starts
)"""


_HISTORY_OUT = """
SELECT product_id, price, rating, stock_quantity, price_category, stock_status,
       end_date IS NULL AS is_active, start_date, end_date, start_date AS last_updated FROM history"""

_AVG = "CAST((2 * sum(cents) + count(cents)) // (2 * count(cents)) AS DOUBLE) / 100"
_TOTAL = "CAST(sum(cents) AS DOUBLE) / 100"

_SALES = f"""WITH {_CLEAN_TX}
SELECT transaction_date, store_type, payment_method, {_TOTAL} AS total_sales,
       count(transaction_id) AS total_transactions, {_AVG} AS avg_order_value,
       CAST(sum(quantity) AS BIGINT) AS total_quantity_sold
FROM facts WHERE order_status <> 'Cancelled' GROUP BY 1, 2, 3"""

_STATS = f"""WITH {_CLEAN_TX}, {_CUSTOMERS}
SELECT customer_id, name, email, min(transaction_date) AS first_order_date,
       max(transaction_date) AS last_order_date,
       CAST(count(DISTINCT transaction_date) AS INTEGER) AS distinct_transaction_dates,
       count(transaction_id) AS total_transactions, {_AVG} AS avg_order_value, {_TOTAL} AS total_spent,
       CAST({AS_OF} - max(transaction_date) AS INTEGER) AS recency_days
FROM facts JOIN customers USING (customer_id) WHERE order_status <> 'Cancelled' GROUP BY 1, 2, 3"""

_PRODUCT_SALES = f"""WITH {_CLEAN_TX}, {_history(2)}
SELECT CAST(f.product_id AS BIGINT) AS product_id, name, brand, category, price_category, transaction_date,
       CAST(sum(quantity) AS BIGINT) AS total_quantity_sold, {_TOTAL} AS total_revenue,
       count(*) AS num_transactions
FROM facts f JOIN history h ON f.product_id = h.product_id AND h.end_date IS NULL
GROUP BY 1, 2, 3, 4, 5, 6"""

_CUSTOMER_OUT = "customer_id, name, email, total_purchases, customer_segment, days_since_registration"

_UPSERTED = f"""WITH {_CUSTOMERS}, {_LATER}
SELECT {_CUSTOMER_OUT} FROM later
UNION ALL SELECT {_CUSTOMER_OUT} FROM customers WHERE customer_id NOT IN (SELECT customer_id FROM later)"""

_PRODUCT_FEED = "brand, category, name, price, product_id, rating, stock_quantity"

ORACLE: dict[str, str] = {
    "scan_project": f"""WITH {_TX}
SELECT transaction_id, customer_id AS transactions_customer_id, quantity, inserted_time AS last_updated FROM tx""",
    "watermark_filter": """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_shipdate AS DATE) AS ship_date
FROM lineitem WHERE l_shipdate > (SELECT max(o_orderdate) FROM orders)""",
    "null_token_filter": f"""WITH {_CUSTOMERS}
SELECT customer_id, email FROM customer_feed WHERE email IS NOT NULL AND lower(trim(email)) <> 'null'""",
    "null_date_filter": f"""WITH {_TX}
SELECT transaction_id, transaction_date FROM tx WHERE transaction_date <> 'null'""",
    "range_filter": f"""WITH {_CUSTOMERS}
SELECT customer_id, age, total_purchases FROM customer_feed
WHERE age >= 18 AND age <= 100 AND total_purchases >= 0""",
    "key_filter": f"""WITH {_TX}
SELECT transaction_id, customer_id, product_id FROM tx
WHERE customer_id IS NOT NULL AND product_id IS NOT NULL""",
    "clamp_columns": f"""WITH {_TX}
SELECT transaction_id, CASE WHEN quantity < 0 THEN 0 ELSE quantity END AS quantity,
       CASE WHEN total_amount < 0 THEN 0 ELSE total_amount END AS total_amount FROM tx""",
    "clamp_product_columns": f"""WITH {_PRODUCTS}
SELECT product_id, price, rating FROM products WHERE load = 1""",
    "clamp_text_number": f"""WITH {_PRODUCTS}
SELECT product_id, stock_quantity FROM products WHERE load = 1""",
    "segment_ladder": f"""WITH {_CUSTOMERS}
SELECT customer_id, CASE WHEN total_purchases > 10000 THEN 'High Value'
       WHEN total_purchases > 5000 THEN 'Medium Value' ELSE 'Low Value' END AS customer_segment
FROM customer_feed""",
    "price_category": f"""WITH {_PRODUCTS}
SELECT product_id, price_category FROM products WHERE load = 1""",
    "stock_status": f"""WITH {_PRODUCTS}
SELECT product_id, stock_status FROM products WHERE load = 1""",
    "order_status": f"""WITH {_TX}
SELECT transaction_id, CASE WHEN quantity <= 0 OR total_amount <= 0 THEN 'Cancelled'
       ELSE 'Completed' END AS order_status FROM tx""",
    "safe_to_date": f"""WITH {_TX}
SELECT transaction_id, TRY_CAST(transaction_date AS DATE) AS transaction_date FROM tx""",
    "days_between": f"""WITH {_CUSTOMERS}
SELECT customer_id, CAST({AS_OF} - registration_date AS INTEGER) AS days_since_registration
FROM customer_feed""",
    "row_fingerprint": f"""WITH {_CUSTOMERS}
SELECT customer_id, md5(concat_ws('|', {", ".join(
    f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    for c in ("customer_id", "name", "email", "country", "gender", "age"))})) AS fingerprint
FROM customer_feed""",
    "temp_view_sql": f"""WITH {_CLEAN_TX}
SELECT store_type, order_status, count(*) AS facts, CAST(sum(quantity) AS BIGINT) AS quantity
FROM facts GROUP BY 1, 2""",
    "latest_by_key": """
SELECT * EXCLUDE (rn, l_shipdate), CAST(l_shipdate AS DATE) AS l_shipdate FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC,
    l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC,
    l_returnflag DESC, l_linestatus DESC) AS rn FROM lineitem) WHERE rn = 1""",
    "anti_join_changed_rows": f"""WITH {_PRODUCTS}
SELECT {_PRODUCT_FEED} FROM loads WHERE load = 1 EXCEPT SELECT {_PRODUCT_FEED} FROM loads WHERE load = 0""",
    "inner_join_customers": f"""WITH {_CLEAN_TX}, {_CUSTOMERS}
SELECT transaction_id, customer_id, name, email, total_amount FROM facts JOIN customers USING (customer_id)""",
    "inner_join_active_products": f"""WITH {_CLEAN_TX}, {_history(2)}
SELECT transaction_id, CAST(f.product_id AS INTEGER) AS product_id, name, brand, price_category, quantity
FROM facts f JOIN history h ON f.product_id = h.product_id AND h.end_date IS NULL""",
    "union_all_staged": f"""WITH {_PRODUCTS},
changed AS (
  SELECT {_PRODUCT_FEED} FROM products WHERE load = 1
  EXCEPT SELECT {_PRODUCT_FEED} FROM products WHERE load = 0
)
SELECT product_id AS merge_key, product_id, price, rating FROM changed
UNION ALL
SELECT CAST(NULL AS BIGINT), product_id, price, rating FROM changed
WHERE product_id IN (SELECT product_id FROM products WHERE load = 0)""",
    "clean_customers": f"""WITH {_CUSTOMERS}
SELECT *, '2001-01-01 00:00:00' AS last_updated FROM customers""",
    "clean_products": f"""WITH {_PRODUCTS}
SELECT {_PRODUCT_FEED}, price_category, stock_status FROM products WHERE load = 1""",
    "clean_transactions": f"""WITH {_CLEAN_TX}
SELECT * EXCLUDE (cents, batch_id) FROM facts""",
    "upsert": _UPSERTED,
    "replayed_changes": _UPSERTED,
    "published_customers": _UPSERTED,
    "changed_images": f"""WITH {_CUSTOMERS}, {_LATER} SELECT {_CUSTOMER_OUT} FROM later""",
    "upsert_changes": f"""WITH {_CUSTOMERS}, {_LATER}
SELECT CASE WHEN customer_id IN (SELECT customer_id FROM customers) THEN 'update_postimage'
       ELSE 'insert' END AS change_type, {_CUSTOMER_OUT} FROM later
UNION ALL
SELECT 'update_preimage', {_CUSTOMER_OUT} FROM customers
WHERE customer_id IN (SELECT customer_id FROM later)""",
    "insert_only_merge": f"""WITH {_CLEAN_TX}
SELECT transaction_id, transaction_date, order_status FROM facts WHERE transaction_date >= DATE '1999-01-01'""",
    "scd2_two_batches": f"WITH {_history(2)} {_HISTORY_OUT}",
    "scd2_revert": f"WITH {_history(3)} {_HISTORY_OUT}",
    "published_history": f"WITH {_history(3)} {_HISTORY_OUT}",
    "scd2_change_rows": f"""WITH {_history(2)}
SELECT 'insert' AS change_type, product_id, price, rating, true AS is_active, CAST(NULL AS VARCHAR) AS end_date
FROM history WHERE load = 1
UNION ALL SELECT 'update_preimage', product_id, price, rating, true, NULL
FROM history WHERE load = 0 AND end_date IS NOT NULL
UNION ALL SELECT 'update_postimage', product_id, price, rating, false, end_date
FROM history WHERE load = 0 AND end_date IS NOT NULL""",
    "advance_cursor": """
SELECT event_type AS table_name, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_inserted_time
FROM events GROUP BY 1""",
    "cursor_after_run": f"""WITH {_TX}
SELECT unnest(['transactions_si', 'sales_summary_gd']) AS table_name, max(batch_id) AS last_version FROM tx
UNION ALL
SELECT unnest(['customers_si', 'products_si', 'customers_stats_gd', 'product_sales_summary_gd']), -1""",
    "changes_since_time": f"""WITH {_CLEAN_TX}
SELECT transaction_id, batch_id AS commit_version, CAST(1996 + batch_id AS VARCHAR) || '-01-01 00:00:00' AS committed
FROM facts WHERE batch_id > 2""",
    "insert_only_published": f"""WITH {_CLEAN_TX}
SELECT transaction_id, transaction_date, batch_id AS commit_version FROM facts""",
    "empty_batch_between": "SELECT *, CAST(6 AS BIGINT) AS last_version FROM ("
    + _SALES.replace("FROM facts WHERE", "FROM facts WHERE batch_id <> 3 AND") + ")",
    "lost_facts": f"""WITH {_CLEAN_TX}, {_CUSTOMERS}, {_PRODUCTS}
SELECT 'sales_summary_gd' AS table_name, CAST(6 AS BIGINT) AS last_version, CAST(0 AS BIGINT) AS facts_lost
UNION ALL SELECT 'customers_stats_gd', 6, count(*) FROM facts
WHERE order_status <> 'Cancelled' AND customer_id NOT IN (SELECT customer_id FROM customers)
UNION ALL SELECT 'product_sales_summary_gd', 6, count(*) FROM facts
WHERE product_id NOT IN (SELECT product_id FROM products WHERE load = 0)""",
    "merge_when_price_differs": f"""WITH {_PRODUCTS}, later AS (
  SELECT product_id, CASE WHEN product_id % 5 <> 0 THEN price END AS price, rating FROM products WHERE load = 1
), earlier AS (SELECT * FROM products WHERE load = 0)
SELECT product_id, CASE WHEN e.product_id IS NULL OR e.price <> l.price THEN l.price ELSE e.price END AS price,
  CASE WHEN e.product_id IS NULL OR e.price <> l.price THEN l.rating ELSE e.rating END AS rating
FROM later l LEFT JOIN earlier e USING (product_id)""",
    "bronze_products": f"""WITH {_PRODUCTS}
SELECT {_PRODUCT_FEED}, CAST(0 AS BIGINT) AS batch_id, CAST(1 AS BIGINT) AS stamps FROM loads WHERE load = 1""",
    "archived_files": f"""WITH {_CUSTOMERS}
SELECT customer_id, name, nullif(email, '') AS email, true AS same_length FROM customer_feed""",
    "sales_summary_one_shot": _SALES,
    "sales_summary_incremental": _SALES,
    "customer_stats_one_shot": _STATS,
    "customer_stats_incremental": _STATS,
    # An empty cell of a CSV file is null, so these customers have no e-mail.
    "files_to_gold": _STATS.replace("WHERE order_status", "WHERE email <> '' AND order_status"),
    "product_sales_one_shot": _PRODUCT_SALES,
    "product_sales_incremental": _PRODUCT_SALES,
    "change_rows": f"""WITH {_CLEAN_TX}
SELECT transaction_id, transaction_date, batch_id AS commit_version, 'insert' AS change_type
FROM facts WHERE batch_id > 2""",
    "json_lines_scan": f"""WITH {_TX}
SELECT * EXCLUDE (inserted_time, batch_id) FROM tx""",
    "json_document_scan": f"""WITH {_PRODUCTS}
SELECT {_PRODUCT_FEED} FROM loads WHERE load = 1""",
    "csv_stream_to_bronze": f"""WITH {_CUSTOMERS}
SELECT * REPLACE (nullif(email, '') AS email), CAST(0 AS BIGINT) AS batch_id FROM customer_feed""",
}
