"""Exact money arithmetic over DOUBLE columns.

Adding doubles depends on the order of the additions, so a retry or another partitioning
can change the last cent of a large total.  Amounts are therefore summed as decimals with
four places: exact and associative.  An amount that is no number, infinite, or beyond 24
digits is unknown; the sum has ten digits more, so no group can overflow it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = "decimal(28,4)"
# Sums of amounts, as they are stored: one digit is left for an addition.
SUM = "decimal(37,4)"


def _known(amount: Column | str) -> Column:
    """The amount, null where it is no finite number of bearable size."""
    c = F.col(amount) if isinstance(amount, str) else amount
    return c.try_cast(AMOUNT)


def exact_total(amount: Column | str) -> Column:
    """Sum of an amount column, not rounded: what is stored and added up; null when no amount is known."""
    return F.sum(_known(amount)).cast(SUM)


def shown(sum_: Column) -> Column:
    """An exact sum rounded half-up to cents, for readers."""
    return F.round(sum_, 2).cast("double")


def total(amount: Column | str) -> Column:
    """Sum of an amount column rounded half-up to cents; null when no amount is known."""
    return shown(F.sum(_known(amount)))


def amounts(amount: Column | str) -> Column:
    """How many amounts ``total`` adds up."""
    return F.count(_known(amount))


def add(a: Column, b: Column) -> Column:
    """``a + b`` where a missing side counts as nothing, as it does inside SUM."""
    return F.coalesce(a + b, a, b)


def add_exact(a: Column, b: Column) -> Column:
    """``add`` for exact sums; the addition of two decimals is one digit wider, the result is not."""
    return F.coalesce((a + b).cast(SUM), a, b)


def mean(total_: Column, n: Column) -> Column:
    """Average in cents, half-up, from a total in cents; null for ``n = 0``.

    Dividing whole cents by a whole count is a single correctly rounded division, so the
    one-shot and the merged average of the same rows agree to the last digit.
    """
    return F.round(F.try_divide(F.rint(total_ * 100), n * 100), 2)
