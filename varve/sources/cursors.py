"""Cursors: one row per table naming the last batch applied to it.

Snapshots also carry their version in their location.  The cursor is written after it, so it
can only lag, and re-applying a batch that is already in the location does nothing.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from varve import schemas
from varve.errors import CursorMissing
from varve.operators.watermark import BEGINNING
from varve.sources.tables import publish_snapshot, snapshot_version

START = -1


def seed_cursors(spark: SparkSession, table: str, names: list[str]) -> None:
    """Give every name that has no cursor yet one at the beginning of time."""
    known = {r["table_name"] for r in spark.table(table).select("table_name").collect()}
    fresh = [(n, BEGINNING, START, 0) for n in names if n not in known]
    if fresh:
        rows = spark.createDataFrame(fresh, schemas.META_SI)
        _replace(spark, table, spark.table(table).unionByName(rows))


def read_cursor(spark: SparkSession, table: str, name: str, default: int | None = None) -> int:
    """Last applied version; raises when there is no such cursor and no default."""
    row = spark.table(table).filter(F.col("table_name") == name).first()
    if row is not None:
        return row["last_version"]
    if default is None:
        raise CursorMissing(name)
    return default


def write_cursor(
    spark: SparkSession, table: str, name: str, version: int, lost: int = 0
) -> None:
    """Move one cursor; its time stamp is when it moved, and ``lost`` adds to its lost facts."""
    cursors = spark.table(table)
    before = cursors.filter(F.col("table_name") == name).agg(F.sum("facts_lost").alias("before"))
    row = before.select(
        F.lit(name).alias("table_name"),
        F.current_timestamp().alias("last_inserted_time"),
        F.lit(version).cast("bigint").alias("last_version"),
        (F.coalesce("before", F.lit(0)) + lost).alias("facts_lost"),
    )
    # A one-row upsert needs no join: the old row leaves, the new one comes in.
    others = cursors.filter(F.col("table_name") != name)
    _replace(spark, table, others.unionByName(row))


def _replace(spark: SparkSession, table: str, rows) -> None:
    # A handful of rows, one file.
    publish_snapshot(spark, table, rows.coalesce(1), snapshot_version(spark, table) + 1)
