"""Row changes: their shape, how to read them, and how to replay them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGE_TYPE, VERSION, COMMITTED = "_change_type", "_commit_version", "_commit_timestamp"
INSERT, PREIMAGE, POSTIMAGE = "insert", "update_preimage", "update_postimage"
NEW_IMAGES = (INSERT, POSTIMAGE)


def read_changes(
    spark: SparkSession,
    table: str,
    since: int,
    until: int | None = None,
    types: Sequence[str] | None = NEW_IMAGES,
) -> DataFrame:
    """Changes of versions in ``(since, until]``.

    The version is a partition column, so only new partitions are listed and read.  A table
    without ``_change_type`` is append-only: every one of its rows is an insert.
    """
    df = spark.table(table).filter(F.col(VERSION) > since)
    if until is not None:
        df = df.filter(F.col(VERSION) <= until)
    if CHANGE_TYPE not in df.columns:
        df = df.withColumn(CHANGE_TYPE, F.lit(INSERT))
    if COMMITTED not in df.columns and "last_updated" in df.columns:
        df = df.withColumn(COMMITTED, F.col("last_updated"))
    return df if types is None else df.filter(F.col(CHANGE_TYPE).isin(*types))


def version_before(spark: SparkSession, table: str, time: datetime) -> int:
    """Newest version of ``table`` committed at or before ``time``; -1 if there is none.

    Commit times rise with versions, so halving finds it: one row of some fifteen versions is
    read where there are 26,000.  Versions are the table's partitions, known to the catalog.
    """
    listed = spark.sql(f"SHOW PARTITIONS {table}").collect()
    versions = sorted({int(r["partition"].split("/")[0].split("=", 1)[1]) for r in listed})

    def committed(version: int) -> datetime | None:
        row = spark.table(table).filter(F.col(VERSION) == version).select(COMMITTED).first()
        return None if row is None else row[0]

    low, high = 0, len(versions)
    while low < high:
        middle = probe = (low + high) // 2
        # A version without rows has no time of its own: that of the next one with rows bounds it.
        while probe < high and (at := committed(versions[probe])) is None:
            probe += 1
        if probe == high or at > time:
            high = middle
        else:
            low = probe + 1
    return versions[low - 1] if low else -1


def read_changes_after(
    spark: SparkSession, table: str, time: datetime, types: Sequence[str] | None = NEW_IMAGES
) -> DataFrame:
    """Changes committed after ``time``: whole versions, so old partitions are not listed or read."""
    return read_changes(spark, table, version_before(spark, table, time), types=types)


def new_images(changes: DataFrame) -> DataFrame:
    """The rows as they are after the changes."""
    return changes.filter(F.col(CHANGE_TYPE).isin(*NEW_IMAGES))


def apply_changes(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target after the changes: rows not updated, plus the new images.

    Only the keys of the changes meet the target, so a small batch is broadcast and the
    target is neither shuffled nor sorted.
    """
    touched = changes.filter(F.col(CHANGE_TYPE) == PREIMAGE).select(*keys)
    kept = target.join(touched, list(keys), "left_anti").select(*target.columns)
    return kept.unionByName(new_images(changes).select(*target.columns))
