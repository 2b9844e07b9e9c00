"""Column rules: boundaries, nulls and dirty text."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from varve.functions import (
    add,
    amounts,
    clamp,
    clamp_text,
    days_since,
    mean,
    month_of,
    order_status,
    present,
    row_fingerprint,
    safe_date,
    total,
)
from varve.plans.clean import customer_segment, price_category, stock_status


@pytest.fixture(scope="module")
def column(spark):
    """Evaluate an expression over one column of values, in order."""

    def evaluate(values, kind, expression):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, c {kind}")
        return [r[0] for r in df.select(expression("c").alias("x"), "i").orderBy("i").select("x").collect()]

    return evaluate


def test_present_folds_case_and_blanks(column):
    texts = ["a@x", " NULL ", "null", "", None, "nullable"]
    assert column(texts, "STRING", lambda c: F.coalesce(present(c), F.lit(False))) == [
        True, False, False, True, False, True,
    ]


def test_present_exact(column):
    texts = ["null", "NULL", " null", None]
    kept = column(texts, "STRING", lambda c: F.coalesce(present(c, fold=False), F.lit(False)))
    assert kept == [False, True, True, False]


def test_clamp(column):
    assert column([-1.0, 0.0, 3.5, 5.0, 6.0, None], "DOUBLE", lambda c: clamp(c, 0, 5)) == [0, 0, 3.5, 5, 5, None]
    assert column([-2, 7, None], "INT", lambda c: clamp(c, lo=0)) == [0, 7, None]
    assert column([-2, 7], "INT", lambda c: clamp(c, hi=5)) == [-2, 5]
    assert column([-2], "INT", lambda c: clamp(c)) == [-2]


def test_clamp_keeps_the_type(spark):
    df = spark.createDataFrame([(-1, -1.0)], "a INT, b DOUBLE").select(clamp("a", lo=0), clamp("b", lo=0))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["int", "double"]


STOCK = ["-3", "0", "9", "10", "49", "50", "abc", None, "-0.5", "3.7", "-3.7", "49.9", "", " 7 ", "1e2", "5000000000"]


def test_clamp_text(column):
    assert column(STOCK, "STRING", lambda c: clamp_text(c, 0)) == [
        "0", "0", "9", "10", "49", "50", "abc", None, "-0.5", "3.7", "0", "49.9", "", " 7 ", "1e2", "5000000000",
    ]


def test_stock_status(column):
    assert column(STOCK, "STRING", lambda c: stock_status(clamp_text(c, 0))) == [
        "Out of Stock", "Out of Stock", "Low Stock", "Moderate Stock", "Moderate Stock", "Sufficient Stock",
        "Sufficient Stock", "Sufficient Stock", "Out of Stock", "Low Stock", "Out of Stock", "Moderate Stock",
        "Sufficient Stock", "Low Stock", "Sufficient Stock", "Sufficient Stock",
    ]


def test_ladders(column):
    assert column([5000, 5001, 10000, 10001, None], "INT", customer_segment) == [
        "Low Value", "Medium Value", "Medium Value", "High Value", "Low Value",
    ]
    assert column([0.0, 100.0, 100.01, 1000.0, 1000.01, None], "DOUBLE", price_category) == [
        "Budget", "Budget", "Standard", "Standard", "Premium", "Budget",
    ]


def test_order_status(spark):
    cases = [
        (0, 5.0, "Cancelled"), (5, 0.0, "Cancelled"), (1, 1.0, "Completed"), (None, 1.0, "Completed"),
        (None, 0.0, "Cancelled"), (0, None, "Cancelled"), (None, None, "Completed"),
    ]
    df = spark.createDataFrame(cases, "q INT, a DOUBLE, want STRING")
    assert df.filter(order_status("q", "a") != F.col("want")).count() == 0


DATES = [
    "2024-02-29", "2023-02-29", "2024-13-40", "01/02/2024", "2024-1-5", "2024", "2024-01", "null", "", None,
    " 2024-01-01", "2024-01-01 ", "2024-01-01T00:00:00", "0000-01-01", "0001-01-01", "9999-12-31", "24-01-01",
]


def test_safe_date_equals_the_format_parser(column):
    fast = column(DATES, "STRING", lambda c: safe_date(c).cast("string"))
    assert fast == column(DATES, "STRING", lambda c: F.try_to_date(F.col(c), "yyyy-MM-dd").cast("string"))
    assert fast[0] == "2024-02-29" and fast[1:9] == [None] * 8
    assert column(["01/02/2024"], "STRING", lambda c: safe_date(c, "dd/MM/yyyy")) == [date(2024, 2, 1)]


def test_days_and_months(column):
    assert column([date(2024, 1, 1), None], "DATE", lambda c: days_since(c, date(2024, 3, 1))) == [60, None]
    assert column([date(2024, 1, 31)], "DATE", month_of) == ["2024-01"]


def test_fingerprints_do_not_collide(spark):
    pairs = [("a|b", "c"), ("a", "b|c"), ("a", None), (None, "a"), ("-", "a"), ("", "a"), ("a", "")]
    df = spark.createDataFrame(pairs, "x STRING, y STRING")
    assert df.select(row_fingerprint("x", "y").alias("f")).distinct().count() == len(pairs)


def test_totals_are_exact_and_half_up(spark):
    df = spark.createDataFrame([(0.1,)] * 3 + [(None,), (float("nan"),)], "a DOUBLE")
    row = df.agg(total("a").alias("t"), mean(total("a"), amounts("a")).alias("m")).first()
    assert (row.t, row.m) == (0.3, 0.1)
    halves = spark.createDataFrame([(10.01, 2), (30.03, 6), (1.0, 0)], "t DOUBLE, n BIGINT")
    assert [r[0] for r in halves.select(mean(F.col("t"), F.col("n"))).collect()] == [5.01, 5.01, None]


def test_total_of_nothing_is_null(spark):
    df = spark.createDataFrame([(None,)], "a DOUBLE")
    assert df.agg(total("a")).first()[0] is None


def test_total_does_not_depend_on_order(spark):
    df = spark.range(200_000).select((F.pmod(F.xxhash64("id"), F.lit(10_000_019)) / 100).alias("a"))
    got = [df.repartition(n).agg(total("a")).first()[0] for n in (1, 7)]
    cents = df.agg(F.sum(F.round(F.col("a") * 100).cast("bigint"))).first()[0]
    assert got == [cents / 100, cents / 100]


def test_add_skips_nulls(spark):
    df = spark.createDataFrame([(1, 2), (None, 2), (1, None), (None, None)], "a BIGINT, b BIGINT")
    assert [r[0] for r in df.select(add(F.col("a"), F.col("b"))).collect()] == [3, 2, 1, None]


def test_safe_date_refuses_a_trailing_line_end(spark):
    row = spark.createDataFrame([("2024-01-01\n",)], "d STRING").select(safe_date("d").alias("d")).first()
    assert row["d"] is None


def test_totals_take_any_amount(spark):
    amounts_ = [(1.25,), (float("inf"),), (float("nan"),), (None,), (1e15,), (1e300,)]
    df = spark.createDataFrame(amounts_, "x DOUBLE")
    assert df.agg(total("x"), amounts("x")).first()[:] == (1e15 + 1.25, 2)
