"""MERGE on plain Spark: every merge is one equi-join between a target and a source.

A merge yields the new table (``rows``) and the row changes (``changes``), both lazy.
``changes`` carries the target's columns plus ``_change_type``: ``insert``,
``update_preimage`` or ``update_postimage``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.operators.changes import CHANGE_TYPE, INSERT, POSTIMAGE, PREIMAGE

_ACTION, _SPREAD, _SEEN = "_varve_action", "_varve_spread", "_varve_seen"


class MergeResult:
    """Both outcomes of a merge; each plan is built when it is asked for."""

    def __init__(self, rows: Callable[[], DataFrame], changes: Callable[[], DataFrame]):
        self._rows, self._changes = rows, changes

    @cached_property
    def rows(self) -> DataFrame:
        return self._rows()

    @cached_property
    def changes(self) -> DataFrame:
        return self._changes()


def old(name: str) -> Column:
    """Target column, value before the merge; for use in merge expressions."""
    return F.col(f"t.{name}")


def new(name: str) -> Column:
    """Source column; for use in merge expressions."""
    return F.col(f"s.{name}")


def _all_known(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _scattered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add a second join key that spreads rows with null keys over many partitions.

    With plain equality such rows match nothing, yet all would hash to one partition.  The
    lane is 0 for complete keys and a hash of the row otherwise.
    """
    return df.withColumn(_SPREAD, F.when(_all_known(keys), F.lit(0)).otherwise(F.xxhash64(*df.columns)))


def _checked(source: DataFrame, keys: Sequence[str], null_safe: bool) -> DataFrame:
    """Mark rows, failing while running if two of them share a key, as SQL MERGE does.

    With plain equality the row number needs the partitioning the join needs anyway, so it
    adds no shuffle.
    """
    by = list(keys) if null_safe else [*keys, _SPREAD]
    repeat = F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0))) > 1
    if not null_safe:
        repeat = repeat & _all_known(keys)
    message = F.lit(f"merge source has several rows for one key {list(keys)}")
    seen = F.when(repeat, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return source.withColumn(_SEEN, seen)


def merge(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update: Mapping[str, Column] | None,
    insert: Mapping[str, Column],
    when: Column | None = None,
    null_safe: bool = False,
    check_unique: bool = True,
) -> MergeResult:
    """Full-outer merge of ``source`` into ``target``.

    ``update`` and ``insert`` map target columns to expressions over :func:`old` and
    :func:`new`; all of them see values from before the merge, and target columns left out
    keep their value on update and are null on insert.  ``when`` restricts the update,
    ``update=None`` makes matches a no-op.  ``null_safe`` lets null keys match each other.
    Pass ``check_unique=False`` only for a source that is unique by construction, null keys
    included: it is then joined in whatever partitioning it already has.
    """
    types = {f.name: f.dataType for f in target.schema.fields}
    t, s = target, source
    scatter = check_unique and not null_safe
    if scatter:
        t, s = _scattered(t, keys), _scattered(s, keys)
    s = _checked(s, keys, null_safe) if check_unique else s.withColumn(_SEEN, F.lit(True))
    t = t.withColumn(_SEEN, F.lit(True))
    same = [old(k).eqNullSafe(new(k)) if null_safe else old(k) == new(k) for k in keys]
    if scatter:
        same.append(old(_SPREAD) == new(_SPREAD))

    matched = old(_SEEN).isNotNull() & new(_SEEN).isNotNull()
    updates = matched if when is None else matched & F.coalesce(when, F.lit(False))
    action = F.when(old(_SEEN).isNull(), F.lit("insert"))
    if update is not None:
        action = action.when(updates, F.lit("update"))
    joined = (
        t.alias("t")
        .join(s.alias("s"), reduce(lambda a, b: a & b, same), "full_outer")
        .withColumn(_ACTION, action.otherwise(F.lit("keep")))
    )

    nothing = F.lit(None)
    is_insert, is_update = F.col(_ACTION) == "insert", F.col(_ACTION) == "update"

    def after(name: str) -> Column:
        value = F.when(is_insert, insert.get(name, nothing).cast(types[name]))
        if update is not None and name in update:
            value = value.when(is_update, update[name].cast(types[name]))
        return value.otherwise(old(name)).alias(name)

    def rows() -> DataFrame:
        return joined.select(*[after(c) for c in target.columns])

    def changes() -> DataFrame:
        image = F.struct(*[after(c) for c in target.columns])
        before = F.struct(*[old(c).alias(c) for c in target.columns])
        images = F.when(
            is_insert, F.array(F.struct(F.lit(INSERT).alias("type"), image.alias("row")))
        ).otherwise(
            F.array(
                F.struct(F.lit(PREIMAGE).alias("type"), before.alias("row")),
                F.struct(F.lit(POSTIMAGE).alias("type"), image.alias("row")),
            )
        )
        # The filter on the source side turns the full-outer join into a source-outer one.
        return (
            joined.filter(new(_SEEN).isNotNull() & (F.col(_ACTION) != "keep"))
            .select(F.explode(images).alias("i"))
            .select("i.row.*", F.col("i.type").alias(CHANGE_TYPE))
        )

    return MergeResult(rows, changes)


def upsert(
    target: DataFrame, source: DataFrame, keys: Sequence[str], check_unique: bool = True
) -> MergeResult:
    """Replace matched rows, insert the rest; source columns the target lacks are ignored."""
    values = {c: new(c) for c in target.columns if c in source.columns}
    return merge(target, source, keys, values, values, check_unique=check_unique)


def insert_only(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows whose key is not in the target yet: rows to append, no table rewrite.

    Only the key columns of the target are read.  Rows with a null key match nothing and
    are all returned.
    """
    return source.join(target.select(*keys), list(keys), "left_anti").select(*source.columns)


def additive_merge(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    set: Mapping[str, Column],
    null_safe: bool = True,
    check_unique: bool = True,
) -> MergeResult:
    """Fold a batch of aggregates into a mart; ``set`` combines :func:`old` and :func:`new`."""
    inserts = {c: new(c) for c in target.columns if c in source.columns}
    return merge(
        target, source, keys, set, inserts, null_safe=null_safe, check_unique=check_unique
    )
