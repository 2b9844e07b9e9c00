"""The three feeds, derived from the driver's tables.

``lineitem`` joined to ``orders`` are transactions, one batch per year of shipping; ``customer``
and ``part`` are the dimensions.  Values are shifted and a few are spoiled, by rules on other
columns, so that every cleaning branch is reached.  ``workload.oracle`` states the same rules
in SQL.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = date(2002, 1, 1)
FIRST_YEAR = 1995
LOADED = [datetime(2001, 1, 1), datetime(2001, 2, 1), datetime(2001, 3, 1)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    year = F.year("day")
    # What only a line decides is settled before the join, which moves small codes instead of doubles.
    narrow = lines.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag",
        (F.col("l_quantity") - 5).cast("int").alias("quantity"),
        F.when(F.col("l_tax") == 0.07, -F.col("l_extendedprice"))
        .otherwise(F.col("l_extendedprice")).alias("total_amount"),
        F.col("l_shipdate").cast("date").alias("day"),
        F.when(F.col("l_discount") == 0.1, "no customer")
        .when((F.col("l_discount") == 0.0) & (F.col("l_tax") == 0.08), "no product")
        .when((F.col("l_tax") == 0.0) & (F.col("l_discount") == 0.09), "no date")
        .when((F.col("l_tax") == 0.0) & (F.col("l_discount") == 0.08), "bad date").alias("spoiled"),
    )
    spoiled = {what: F.col("spoiled") == what for what in ("no customer", "no product", "no date", "bad date")}
    return narrow.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("transaction_id"),
        F.when(spoiled["no customer"], None).otherwise(F.col("o_custkey")).cast("int").alias("customer_id"),
        F.when(spoiled["no product"], None).otherwise(F.col("l_partkey")).cast("int").alias("product_id"),
        "quantity",
        "total_amount",
        F.when(spoiled["no date"], "null").when(spoiled["bad date"], "2024-13-40")
        .otherwise(F.col("day").cast("string")).alias("transaction_date"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("payment_method"),
        F.col("l_returnflag").alias("store_type"),
        F.make_timestamp(year, F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0)).alias("inserted_time"),
        (year - FIRST_YEAR).cast("bigint").alias("batch_id"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("c_nationkey")
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("int").alias("customer_id"),
        F.col("c_name").alias("name"),
        F.when(nation == 0, None).when(nation == 1, " NULL ").when(nation == 2, "")
        .otherwise(F.concat(F.lower("c_name"), F.lit("@example.com"))).alias("email"),
        F.concat(F.lit("N"), nation.cast("string")).alias("country"),
        F.col("c_mktsegment").alias("customer_type"),
        F.date_add(F.lit(date(1990, 1, 1)), nation * 30).alias("registration_date"),
        (nation * 4 + 10).cast("int").alias("age"),
        F.lit(None).cast("string").alias("gender"),
        F.floor(F.col("c_acctbal") * 2).cast("int").alias("total_purchases"),
        F.lit(LOADED[0]).alias("inserted_time"),
    )


def customers_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as their orders describe them: everyone reachable, spending from all orders."""
    spent = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("orders")
    )
    return read(spark, sf_dir, "customer").join(spent, "c_custkey").select(
        F.col("c_custkey").cast("int").alias("customer_id"),
        F.concat(F.col("c_name"), F.lit("*")).alias("name"),
        F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("country"),
        F.col("c_mktsegment").alias("customer_type"),
        F.lit(date(1990, 1, 1)).alias("registration_date"),
        F.lit(40).alias("age"),
        F.lit(None).cast("string").alias("gender"),
        (F.col("orders") * 1000).cast("int").alias("total_purchases"),
        F.lit(LOADED[1]).alias("inserted_time"),
    )


def products(spark: SparkSession, sf_dir: str, load: int = 0) -> DataFrame:
    """One of three loads of the product catalog.

    The first lacks one brand; the second has it, with new prices for large parts and new
    ratings for some others; the third is the second with the first load's values.
    """
    size = F.col("p_size")
    price = F.col("p_retailprice") * (size - 10) / 10
    rating = size / 5.0 - 1
    if load == 1:
        price = F.when(size > 25, price * 2).otherwise(price)
        rating = F.when((size >= 20) & (size <= 25), rating - 0.5).otherwise(rating)
    parts = read(spark, sf_dir, "part")
    if load == 0:
        parts = parts.filter(F.col("p_brand") != "Brand#1")
    return parts.select(
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("name"),
        price.alias("price"),
        F.col("p_partkey").alias("product_id"),
        rating.alias("rating"),
        F.when(size == 13, "abc").when(size == 14, "3.7").when(size == 15, None)
        .when(size == 16, "-0.5").otherwise((size * 2 - 20).cast("string")).alias("stock_quantity"),
        F.lit(LOADED[load]).alias("inserted_time"),
    )
