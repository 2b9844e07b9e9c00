"""High watermarks: how far a table has come, and what is newer than that."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGINNING = datetime(1900, 1, 1)


def high_watermark(df: DataFrame, col: str, default: Any = BEGINNING) -> Any:
    """Largest value of ``col``, or ``default`` when there is none (one scalar is collected)."""
    value = df.agg(F.max(col)).first()[0]
    return default if value is None else value


def newer_than(df: DataFrame, col: str, mark: Any = BEGINNING) -> DataFrame:
    """Rows strictly after the watermark; the literal reaches the scan as a pushed filter."""
    return df.filter(F.col(col) > F.lit(mark).cast(df.schema[col].dataType))
