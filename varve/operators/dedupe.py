"""Keeping one row per key, and keeping rows that are not there yet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_REST = "_varve_rest"


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of every key (null keys form one group).

    Newest is the greatest in the ``order`` columns; the other columns break ties, so the
    survivor never depends on partitioning.  As an aggregate it is folded before the shuffle:
    each map task sends at most one row per key, however hot the key is.
    """
    ties = [c for c in df.columns if c not in {*order, *keys}]
    newest = F.max(F.struct(*order, *ties)).alias(_REST)
    picked = {c: F.col(c) if c in keys else F.col(f"{_REST}.{c}").alias(c) for c in df.columns}
    return df.groupBy(*keys).agg(newest).select(*picked.values())


def rows_not_in(df: DataFrame, other: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose ``cols`` equal those of no row in ``other``; null equals null.

    Null-safe equalities plan as an ordinary hash-partitioned anti join.  AQE broadcasts
    ``other`` when it is measured to be small and splits a skewed ``df`` partition otherwise.
    """
    left, right = df.alias("l"), other.select(*cols).alias("r")
    same = reduce(
        lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in cols]
    )
    return left.join(right, same, "left_anti")
