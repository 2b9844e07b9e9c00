"""Slowly changing dimension, type 2: one active row per key, closed rows kept as history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.operators.changes import CHANGE_TYPE, INSERT, POSTIMAGE, PREIMAGE
from varve.operators.merge import MergeResult, upsert

META = ("is_active", "start_date", "end_date", "last_updated")


class _Step:
    """The columns both directions of the merge are built from, over a join of s and t."""

    def __init__(self, active: DataFrame, source: DataFrame, key: str, how: str,
                 track_cols: Sequence[str] | None, ts: str, check_unique: bool):
        self.active = active
        tracked = list(track_cols or [c for c in active.columns if c not in META and c != key])
        self.joined = (
            source.withColumn("_sent", _once(source, key) if check_unique else F.lit(True)).alias("s")
            .join(
                active.withColumn("_known", F.lit(True)).alias("t"),
                F.col(f"s.{key}") == F.col(f"t.{key}"),
                how,
            )
        )
        same = F.lit(True)
        for c in tracked:
            same = same & F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}"))
        self.known = F.col("t._known").isNotNull()
        self.sent = F.col("s._sent").isNotNull()
        self.same = same
        stamp = F.col(f"s.{ts}")
        self.was = self._row("t", {})
        self.closed = self._row("t", {"is_active": F.lit(False), "end_date": stamp})
        self.opened = self._row("s", {
            "is_active": F.lit(True), "start_date": stamp,
            "end_date": F.lit(None), "last_updated": stamp,
        })

    def _row(self, side: str, values: dict[str, Column]) -> Column:
        return F.struct(*[
            values.get(f.name, F.col(f"{side}.{f.name}")).cast(f.dataType).alias(f.name)
            for f in self.active.schema.fields
        ])


def _once(source: DataFrame, key: str) -> Column:
    """True, failing while running for a second row of a key; null keys match nothing and may repeat.

    Rows without a key are spread by a hash of the row, so that they are no hot group.
    """
    lane = F.when(F.col(key).isNull(), F.xxhash64(*source.columns))
    repeat = (F.row_number().over(Window.partitionBy(key, lane).orderBy(F.lit(0))) > 1) & F.col(key).isNotNull()
    message = F.lit(f"history source has several rows for one key ['{key}']")
    return F.when(repeat, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))


def _image(kind: str, row: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), row.alias("row"))


def scd2_changes(
    active: DataFrame,
    source: DataFrame,
    key: str,
    track_cols: Sequence[str] | None = None,
    ts: str = "inserted_time",
    check_unique: bool = True,
) -> DataFrame:
    """Row changes that bring the active rows up to date with ``source``.

    A key whose tracked columns differ (null-safely) from its active row gives the row as it
    was, the row closed at the source's ``ts``, and a new active version starting there; an
    unknown key gives a first version; an unchanged key gives nothing.  A source with several
    rows for a key fails; pass ``check_unique=False`` only for one that is unique by construction.
    """
    step = _Step(active, source, key, "left_outer", track_cols, ts, check_unique)
    images = F.when(
        step.known,
        F.array(_image(PREIMAGE, step.was), _image(POSTIMAGE, step.closed), _image(INSERT, step.opened)),
    ).otherwise(F.array(_image(INSERT, step.opened)))
    return (
        step.joined.filter(F.col("s._sent") & (~step.known | ~step.same))
        .select(F.explode(images).alias("i"))
        .select("i.row.*", F.col("i.type").alias(CHANGE_TYPE))
    )


def active_after(active: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The active rows after the changes: every key that was closed or is new has one insert."""
    opened = changes.filter(F.col(CHANGE_TYPE) == INSERT)
    return upsert(active, opened, [key], check_unique=False).rows


def scd2_merge(
    history: DataFrame,
    source: DataFrame,
    key: str,
    track_cols: Sequence[str] | None = None,
    ts: str = "inserted_time",
    check_unique: bool = True,
) -> MergeResult:
    """Merge one batch into a history table holding active and closed rows.

    One full-outer join of the active rows with the batch; closed rows pass it by.
    """
    active = history.filter("is_active")
    closed = history.filter("NOT coalesce(is_active, false)")

    def rows() -> DataFrame:
        step = _Step(active, source, key, "full_outer", track_cols, ts, check_unique)
        versions = (
            F.when(~step.known, F.array(step.opened))
            .when(~step.sent | step.same, F.array(step.was))
            .otherwise(F.array(step.closed, step.opened))
        )
        current = step.joined.select(F.explode(versions).alias("row")).select("row.*")
        return current.unionByName(closed)

    return MergeResult(rows, lambda: scd2_changes(active, source, key, track_cols, ts, check_unique))
