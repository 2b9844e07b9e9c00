"""The three marts: their exact state, how a batch folds into it, and what readers see of it.

A state holds what adds up without loss: unrounded sums, how many amounts they hold, and the days
of a customer as bits.  Folding states is associative, so a mart does not depend on how its facts
came in batches; totals in cents, averages and counts of days are derived from the state where it
is read (``*_SHOWN``, also the text of the published views).

Facts are aggregated to their join key before they meet a dimension.  Both dimensions have one
row per key, so the result is the same, the join input shrinks to one row per key (and day), and
a customer or product holding a third of all facts is already folded map-side.

Days are kept as one 31-bit mask for each month a customer bought in.  A ``bitmap_construct_agg``
bitmap is 4,096 bytes for every customer, however few days it has, also in the hash tables and
shuffles of the aggregation; the masks are 8 bytes a month.  They are made of the distinct dates of a
customer, which one aggregate collects: no more than there are days, also of a hot customer.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions import days_since
from varve.functions.money import add, add_exact, amounts, exact_total
from varve.functions.rules import CANCELLED
from varve.operators.merge import MergeResult, additive_merge, new, old

SALES_KEYS = ("transaction_date", "store_type", "payment_method")
CUSTOMER_KEYS = ("customer_id",)
PRODUCT_KEYS = ("product_id", "name", "brand", "category", "price_category", "transaction_date")

_TOTAL = "CAST(round(spent, 2) AS DOUBLE)"
# Whole cents by a whole count is one correctly rounded division; null where no amount is known.
_MEAN = f"round(try_divide(rint({_TOTAL} * 100), amounts * 100), 2)"
_DAYS = "aggregate(map_values(order_days), 0, (n, days) -> n + bit_count(days))"

SALES_SHOWN = (
    *SALES_KEYS, f"{_TOTAL} AS total_sales", "total_transactions", f"{_MEAN} AS avg_order_value",
    "total_quantity_sold", "last_updated",
)
CUSTOMERS_SHOWN = (
    "customer_id", "name", "email", "first_order_date", "last_order_date", f"{_DAYS} AS distinct_transaction_dates",
    "total_transactions", f"{_MEAN} AS avg_order_value", f"{_TOTAL} AS total_spent", "recency_days", "last_updated",
)
PRODUCTS_SHOWN = (*PRODUCT_KEYS, "total_quantity_sold", f"{_TOTAL} AS total_revenue", "num_transactions", "last_updated")


def _now(stamp: Column | None) -> Column:
    return F.current_timestamp() if stamp is None else stamp


def counted(tx: DataFrame) -> DataFrame:
    """Facts that count as sales."""
    return tx.filter(F.col("order_status") != CANCELLED)


# Sales by day, store type and payment method ------------------------------------------------


def sales_state(tx: DataFrame, stamp: Column | None = None) -> DataFrame:
    return (
        counted(tx)
        .groupBy(*SALES_KEYS)
        .agg(
            exact_total("total_amount").alias("spent"),
            amounts("total_amount").alias("amounts"),
            F.count("transaction_id").alias("total_transactions"),
            F.sum("quantity").alias("total_quantity_sold"),
        )
        .withColumn("last_updated", _now(stamp))
    )


def fold_sales(state: DataFrame, batch: DataFrame) -> MergeResult:
    return additive_merge(
        state,
        batch,
        SALES_KEYS,
        {
            "spent": add_exact(old("spent"), new("spent")),
            "amounts": old("amounts") + new("amounts"),
            "total_transactions": old("total_transactions") + new("total_transactions"),
            "total_quantity_sold": add(old("total_quantity_sold"), new("total_quantity_sold")),
            "last_updated": new("last_updated"),
        },
        check_unique=False,
    )


def sales_summary(tx: DataFrame, stamp: Column | None = None) -> DataFrame:
    return sales_state(tx, stamp).selectExpr(*SALES_SHOWN)


# Statistics per customer --------------------------------------------------------------------


def customer_totals(tx: DataFrame) -> DataFrame:
    """Counted facts per customer, known or not; days as bits."""
    totals = (
        counted(tx)
        .groupBy("customer_id")
        .agg(
            F.sort_array(F.collect_set("transaction_date")).alias("dates"),
            F.count("transaction_id").alias("total_transactions"),
            exact_total("total_amount").alias("spent"),
            amounts("total_amount").alias("amounts"),
        )
    )
    return totals.select(
        "customer_id",
        F.array_min("dates").alias("first_order_date"),
        F.array_max("dates").alias("last_order_date"),
        _month_masks(F.col("dates")).alias("order_days"),
        "total_transactions",
        "spent",
        "amounts",
    )


def _month_masks(dates: Column) -> Column:
    """Distinct dates, in order, as a map from their month to its days as bits: one pass over them."""

    def month(day: Column) -> Column:
        return F.year(day) * 12 + F.month(day)

    def state(months: Column, masks: Column, month: Column, mask: Column) -> Column:
        return F.struct(months.alias("months"), masks.alias("masks"), month.alias("month"), mask.alias("mask"))

    def with_day(seen: Column, day: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1), F.day(day) - 1)
        same = state(seen["months"], seen["masks"], seen["month"], seen["mask"].bitwiseOR(bit))
        return F.when(seen["month"] == month(day), same).otherwise(state(*closed(seen), month(day), bit))

    def closed(seen: Column) -> tuple[Column, Column]:
        return F.array_append(seen["months"], seen["month"]), F.array_append(seen["masks"], seen["mask"])

    none = F.array().cast("array<int>")
    masks = F.aggregate(
        dates, state(none, none, month(F.get(dates, 0)), F.lit(0)), with_day, lambda seen: F.map_from_arrays(*closed(seen))
    )
    return F.when(F.size(dates) == 0, F.map_from_arrays(none, none)).otherwise(masks)


def with_customer(totals: DataFrame, customers: DataFrame, how: str = "inner") -> DataFrame:
    """Totals with name and e-mail; ``how="left"`` keeps those of unknown customers, marked by ``is_known``."""
    named = customers.select("customer_id", "name", "email", F.lit(True).alias("_known"))
    joined = totals.join(named, "customer_id", how)
    return joined.withColumn("is_known", F.col("_known").isNotNull()).drop("_known")


def customer_state(
    totals: DataFrame, as_of: Column | date | None = None, stamp: Column | None = None
) -> DataFrame:
    """The state of known customers' totals (see :func:`with_customer`)."""
    return totals.filter("is_known").select(
        "customer_id",
        "name",
        "email",
        "first_order_date",
        "last_order_date",
        "order_days",
        "total_transactions",
        "spent",
        "amounts",
        days_since("last_order_date", as_of).alias("recency_days"),
        _now(stamp).alias("last_updated"),
    )


def fold_customers(
    state: DataFrame, batch: DataFrame, as_of: Column | date | None = None
) -> MergeResult:
    last = F.greatest(old("last_order_date"), new("last_order_date"))
    days = F.map_zip_with(
        old("order_days"), new("order_days"), lambda _, a, b: F.coalesce(a.bitwiseOR(b), a, b)
    )
    return additive_merge(
        state,
        batch,
        CUSTOMER_KEYS,
        {
            "name": new("name"),
            "email": new("email"),
            "first_order_date": F.least(old("first_order_date"), new("first_order_date")),
            "last_order_date": last,
            "order_days": days,
            "total_transactions": old("total_transactions") + new("total_transactions"),
            "spent": add_exact(old("spent"), new("spent")),
            "amounts": old("amounts") + new("amounts"),
            "recency_days": days_since(last, as_of),
            "last_updated": new("last_updated"),
        },
        null_safe=False,
        check_unique=False,
    )


def customer_stats(
    tx: DataFrame, customers: DataFrame, as_of: Column | date | None = None, stamp: Column | None = None
) -> DataFrame:
    known = with_customer(customer_totals(tx), customers)
    return customer_state(known, as_of, stamp).selectExpr(*CUSTOMERS_SHOWN)


# Sales per product and day ------------------------------------------------------------------


def product_days(tx: DataFrame) -> DataFrame:
    """All facts, cancelled ones included, per product and day."""
    days = tx.groupBy("product_id", "transaction_date").agg(
        F.sum("quantity").alias("total_quantity_sold"),
        exact_total("total_amount").alias("spent"),
        F.count("*").alias("num_transactions"),
    )
    return days.withColumn("product_id", F.col("product_id").cast("bigint"))


def with_product(days: DataFrame, active_products: DataFrame, how: str = "inner") -> DataFrame:
    """Days with the active product's columns; ``how="left"`` keeps those of unknown products, marked by ``is_known``."""
    named = active_products.select(
        "product_id", "name", "brand", "category", "price_category", F.lit(True).alias("_known")
    )
    joined = days.join(named, "product_id", how)
    return joined.withColumn("is_known", F.col("_known").isNotNull()).drop("_known")


def product_state(days: DataFrame, stamp: Column | None = None) -> DataFrame:
    return days.filter("is_known").select(
        *PRODUCT_KEYS, "total_quantity_sold", "spent", "num_transactions", _now(stamp).alias("last_updated")
    )


def fold_products(state: DataFrame, batch: DataFrame) -> MergeResult:
    return additive_merge(
        state,
        batch,
        PRODUCT_KEYS,
        {
            "total_quantity_sold": add(old("total_quantity_sold"), new("total_quantity_sold")),
            "spent": add_exact(old("spent"), new("spent")),
            "num_transactions": old("num_transactions") + new("num_transactions"),
            "last_updated": new("last_updated"),
        },
        check_unique=False,
    )


def product_sales(
    tx: DataFrame, active_products: DataFrame, stamp: Column | None = None
) -> DataFrame:
    known = with_product(product_days(tx), active_products)
    return product_state(known, stamp).selectExpr(*PRODUCTS_SHOWN)
