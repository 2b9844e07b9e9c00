"""Catalog tables: creating them, and publishing new contents so that a retry is harmless.

Three kinds of table cover every layer.

* *Append by version*: partitions named after the batch that wrote them.  A retry overwrites
  its own partition, nothing else.
* *Snapshot*: the whole table lives in one directory named ``v<version>``; publishing writes
  the next directory and then moves the table's location, which is one catalog call.
* *Partitioned snapshot*: the same per partition, so a batch rewrites only the partitions it
  touches.
* *Sliced snapshot*: a partitioned one whose partitions are hash slices of its key, which are also
  its buckets: a batch rewrites only the slices of its keys, and joins by key do not shuffle it.

A location says which version produced it, so table contents and cursor cannot disagree: a
batch whose version is already in the location is not applied again.  One writer per table.

The folders say everything the catalog knows: which versions there are, and, by the ``_SUCCESS``
file of the job that wrote them, which are complete.  A table that is created where folders
already stand takes up what is complete, so a catalog that did not outlive its session is
rebuilt by setup.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from varve.errors import DatabaseMissing, NotNullViolated
from varve.operators.changes import CHANGE_TYPE, COMMITTED, VERSION

LAYERS = ("bronze", "silver", "gold")
# Of the files of all tables: a fifth to a third smaller than Spark's default.
WRITTEN = {"compression": "zstd"}
BATCH, MONTH, SLICE = "batch_id", "transaction_month", "slice"
# Only the table's own folder counts: the last one, or the one before ``name=value``.
_VERSIONED = re.compile(r"/v(\d+)(?:/[^/=]+=[^/]*)?/?$")


@dataclass(frozen=True)
class Settings:
    """Where an environment lives: every path is explicit or derived from ``root``."""

    root: str
    env: str = "dev"
    landing: dict[str, str] = field(default_factory=dict)
    archive: dict[str, str] = field(default_factory=dict)
    # Buckets of keyed snapshots; the session's shuffle partitions at setup when not given.
    buckets: int | None = None

    def database(self, layer: str) -> str:
        return f"{self.env}_{layer}"

    def table(self, layer: str, name: str) -> str:
        return f"{self.database(layer)}.{name}"

    def layer_path(self, layer: str) -> str:
        return f"{self.root}/{self.env}/{layer}"

    def landing_path(self, feed: str) -> str:
        return self.landing.get(feed, f"{self.root}/{self.env}/landing/{feed}")

    def archive_path(self, feed: str) -> str:
        return self.archive.get(feed, f"{self.root}/{self.env}/archive/{feed}")

    def checkpoint_path(self, feed: str) -> str:
        return f"{self.root}/{self.env}/checkpoints/{feed}"


# Creating -----------------------------------------------------------------------------------


def create_database(spark: SparkSession, name: str, location: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}` LOCATION '{location}'")


def _require_database(spark: SparkSession, table: str) -> None:
    database = table.split(".")[0]
    if not spark.catalog.databaseExists(database):
        raise DatabaseMissing(database)


def create_append_table(
    spark: SparkSession, table: str, ddl: str, location: str, partitions: str
) -> None:
    """``partitions`` is DDL, outermost (the version) first."""
    _require_database(spark, table)
    if spark.catalog.tableExists(table):
        return
    names = [p.split()[0] for p in partitions.split(",")]
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({ddl}, {partitions}) USING parquet "
        f"PARTITIONED BY ({', '.join(names)}) LOCATION '{location}'"
    )
    _recover_versions(spark, table, location, *names)


def create_change_table(spark: SparkSession, table: str, ddl: str, location: str) -> None:
    """Row changes of a table, laid out so that version and kind prune the scan."""
    create_append_table(
        spark,
        table,
        f"{ddl}, {COMMITTED} TIMESTAMP",
        location,
        f"{VERSION} BIGINT, {CHANGE_TYPE} STRING",
    )


def create_snapshot_table(
    spark: SparkSession,
    table: str,
    ddl: str,
    location: str,
    partition: str | None = None,
    key: str | None = None,
    buckets: int | None = None,
) -> None:
    """With a ``key`` the table is bucketed, so merging a batch into it does not shuffle it."""
    _require_database(spark, table)
    if spark.catalog.tableExists(table):
        return
    columns, layout = ddl, ""
    if partition:
        columns, layout = f"{ddl}, {partition}", f"PARTITIONED BY ({partition.split()[0]})"
    if key:
        count = _lasting_buckets(spark, location, buckets)
        layout = f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {count} BUCKETS"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet {layout} "
        f"LOCATION '{location}/initial'"
    )
    if partition:
        _recover_partitions(spark, table, location, partition.split()[0])
    else:
        newest = max(_complete_versions(spark, f"{location}/v"), default=-1)
        if newest >= 0:
            spark.sql(f"ALTER TABLE {table} SET LOCATION '{location}/v{newest}'")


def create_sliced_table(
    spark: SparkSession, table: str, ddl: str, location: str, key: str, slices: int | None = None
) -> None:
    """A snapshot cut into hash slices of ``key``, of which a publish rewrites only those it touches.

    A slice is a bucket with a partition of its own: its number is the one Spark gives the bucket of
    its keys.  So a join by key reads the buckets without a shuffle, and a filter by slice is
    answered by the catalog.
    """
    _require_database(spark, table)
    if spark.catalog.tableExists(table):
        return
    count = _lasting_buckets(spark, location, slices)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({ddl}, {SLICE} INT) USING parquet PARTITIONED BY ({SLICE}) "
        f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {count} BUCKETS LOCATION '{location}/initial'"
    )
    _recover_partitions(spark, table, location, SLICE)


def _lasting_buckets(spark: SparkSession, location: str, wanted: int | None) -> int:
    """How many buckets the folders of a table are written with.

    The first to create the table decides (the session's shuffle partitions where nothing is
    ``wanted``); a file's name keeps it, as later sessions may have other settings.
    """
    fs, pattern = _hadoop(spark, f"{location}/_buckets_*")
    for status in fs.globStatus(pattern) or []:
        return int(status.getPath().getName().rsplit("_", 1)[1])
    count = wanted or int(spark.conf.get("spark.sql.shuffle.partitions"))
    _touch(spark, f"{location}/_buckets_{count}")
    return count


# Recovering ---------------------------------------------------------------------------------

# Partitions added by one statement.
_AT_ONCE = 500


def _complete_versions(spark: SparkSession, prefix: str) -> list[int]:
    """Versions n of the folders ``<prefix>n`` whose job ended; their files may be read."""
    fs, hadoop_path = _hadoop(spark, f"{prefix}*/_SUCCESS")
    folders = [s.getPath().getParent().getName() for s in fs.globStatus(hadoop_path) or []]
    start = len(prefix.rsplit("/", 1)[1])
    return sorted(int(f[start:]) for f in folders if f[start:].isdigit())


def _add_partitions(spark: SparkSession, table: str, specs: Sequence[str]) -> None:
    for start in range(0, len(specs), _AT_ONCE):
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS " + " ".join(specs[start : start + _AT_ONCE]))


def _recover_versions(
    spark: SparkSession, table: str, location: str, version_col: str, then_by: str | None = None
) -> None:
    """Add the partitions of complete versions; one that was cut off is written again by its retry."""
    versions = _complete_versions(spark, f"{location}/{version_col}=")
    if then_by is None:
        below = {v: [""] for v in versions}
    else:
        below = {
            v: [f", {then_by} = '{value}'" for value in values]
            for v, values in values_of_versions(spark, location, versions, then_by, version_col).items()
        }
    _add_partitions(spark, table, [f"PARTITION ({version_col} = {v}{b})" for v in versions for b in below.get(v, [])])


def _recover_partitions(spark: SparkSession, table: str, location: str, partition: str) -> None:
    """Every partition of the newest complete version that holds it."""
    newest: dict[str, int] = {}
    for version in _complete_versions(spark, f"{location}/v"):
        for value in _values_below(spark, f"{location}/v{version}", partition):
            newest[value] = version
    _add_partitions(
        spark, table,
        [f"PARTITION ({partition} = '{m}') LOCATION '{location}/v{v}/{partition}={m}'" for m, v in sorted(newest.items())],
    )


# Looking up ---------------------------------------------------------------------------------


def location_of(spark: SparkSession, table: str, partition: dict[str, str] | None = None) -> str:
    spec = ""
    if partition:
        spec = " PARTITION (" + ", ".join(f"{k} = '{v}'" for k, v in partition.items()) + ")"
    return _described(spark, f"{table}{spec}")["Location"]


def _described(spark: SparkSession, what: str) -> dict[str, str]:
    # Already on the driver: the answer of a catalog command, not a job.
    answer = spark.sql(f"DESCRIBE TABLE EXTENDED {what}").collect()
    # The first of a repeated name counts: a partition's location precedes its table's.
    return {r["col_name"]: r["data_type"] for r in reversed(answer)}


def version_in(location: str) -> int:
    """Version named by a location; -1 before the first publish."""
    found = _VERSIONED.search(location)
    return int(found.group(1)) if found else -1


def snapshot_version(spark: SparkSession, table: str) -> int:
    return version_in(location_of(spark, table))


def sliced_version(spark: SparkSession, table: str) -> int:
    """Last version of a sliced table whose slices are all in place; -1 before the first publish."""
    base = location_of(spark, table).rsplit("/", 1)[0]
    return max((version for version, _ in _published(spark, base)), default=-1)


def _published(spark: SparkSession, base: str) -> list[tuple[int, object]]:
    fs, pattern = _hadoop(spark, f"{base}/_published_*")
    found = [s.getPath() for s in fs.globStatus(pattern) or []]
    return [(int(path.getName().rsplit("_", 1)[1]), path) for path in found]


def touched_slices(spark: SparkSession, table: str, rows: DataFrame) -> list[int]:
    """Slices of the keys in ``rows``: no more numbers than the table has slices."""
    number = _slice_number(spark, table, _described(spark, table))
    return sorted(r[0] for r in rows.select(number.alias(SLICE)).distinct().collect())


def in_slices(spark: SparkSession, table: str, slices: Sequence[int]) -> DataFrame:
    """The rows of some slices; the others are neither listed nor read."""
    return spark.table(table).filter(F.col(SLICE).isin(list(slices))).drop(SLICE)


def _slice_number(spark: SparkSession, table: str, described: dict[str, str]) -> Column:
    key = _bucket_columns(described)[0]
    # Of the table's type, because equal numbers of other types have other hashes.
    typed = F.col(key).cast(spark.table(table).schema[key].dataType)
    return F.pmod(F.hash(typed), F.lit(int(described["Num Buckets"]))).cast("int")


def _bucket_columns(described: dict[str, str]) -> list[str]:
    return re.findall(r"`([^`]+)`", described["Bucket Columns"])


def partition_values(
    spark: SparkSession, table: str, name: str, within: dict[str, int] | None = None
) -> list[str]:
    """Distinct values of one partition column, from the catalog alone."""
    spec = ""
    if within:
        spec = " PARTITION (" + ", ".join(f"{k} = {v}" for k, v in within.items()) + ")"
    listed = spark.sql(f"SHOW PARTITIONS {table}{spec}").collect()
    pairs = (level.split("=", 1) for r in listed for level in r["partition"].split("/"))
    return sorted({value for key, value in pairs if key == name})


def values_of_versions(
    spark: SparkSession, location: str, versions: Sequence[int], name: str, version_col: str = VERSION
) -> dict[int, list[str]]:
    """Values of the partition column ``name`` that each of ``versions`` wrote, from their folders alone.

    What it costs depends on the versions asked for, not on how many the table has.
    """
    found: dict[int, list[str]] = {}
    for start in range(0, len(versions), _AT_ONCE):
        some = ",".join(str(v) for v in versions[start : start + _AT_ONCE])
        fs, hadoop_path = _hadoop(spark, f"{location}/{version_col}={{{some}}}/{name}=*")
        for status in fs.globStatus(hadoop_path) or []:
            path = status.getPath()
            version = int(path.getParent().getName().split("=", 1)[1])
            found.setdefault(version, []).append(path.getName().split("=", 1)[1])
    return {v: sorted(values) for v, values in found.items()}


def partition_versions(
    spark: SparkSession, table: str, name: str, values: Iterable[str]
) -> dict[str, int]:
    """Version that produced each partition; partitions that do not exist are left out."""
    existing = set(partition_values(spark, table, name)) & set(values)
    return {v: version_in(location_of(spark, table, {name: v})) for v in sorted(existing)}


# Publishing ---------------------------------------------------------------------------------


def append_version(
    spark: SparkSession,
    table: str,
    rows: DataFrame,
    version: int,
    version_col: str = VERSION,
    then_by: str | None = None,
    ranges_of: str | None = None,
) -> None:
    """Write ``rows`` as the partition of ``version``, replacing what a failed try left there.

    The partition's directory is written by path, because ``rows`` may read earlier versions
    of the same table, which INSERT OVERWRITE refuses.  With ``then_by`` REBALANCE gives files of the
    advisory size: it splits a value that holds most of the batch and merges slivers.  With ``ranges_of``
    files hold sorted ranges of that column, so that a lookup by it reads one file of the version;
    Spark reads ``rows`` once more to find the ranges.  With neither, every task that reads ``rows``
    writes a file: tasks read small files together and large ones in splits, so nothing is shuffled.
    """
    path = f"{location_of(spark, table)}/{version_col}={version}"
    rows = _in_table_shape(spark, table, rows, without=(version_col,))
    if ranges_of:
        # The hash cuts the range of a value that holds much of the batch.
        ranges = rows.repartitionByRange(F.col(ranges_of), F.xxhash64(*rows.columns))
        rows = ranges.sortWithinPartitions(*([then_by] if then_by else []), ranges_of)
    elif then_by:
        rows = rows.hint("rebalance", then_by)
    writer = rows.write.mode("overwrite").options(**WRITTEN)
    if then_by is None:
        writer.parquet(path)
        written = [""]
    else:
        writer.partitionBy(then_by).parquet(path)
        written = [f", {then_by} = '{value}'" for value in _values_below(spark, path, then_by)]
    _add_partitions(spark, table, [f"PARTITION ({version_col} = {version}{w})" for w in written])
    spark.catalog.refreshTable(table)


def append_versions(
    spark: SparkSession,
    table: str,
    rows: DataFrame,
    versions: Sequence[int],
    then_by: str,
    version_col: str = VERSION,
    sort_by: Sequence[str] = (),
    spread: bool = True,
) -> None:
    """Write ``rows``, which carry their version, as the partitions of several versions in one job.

    Files are sorted by ``sort_by``, so that page indexes narrow a lookup by it.  A retry replaces the partitions it
    writes again; a version is complete by its mark, also one without rows.  Pass ``spread=False`` for rows that
    already lie as they are to be written: they are not shuffled.
    """
    location = location_of(spark, table)
    rows = _in_table_shape(spark, table, rows)
    if spread:
        rows = rows.hint("rebalance", version_col, then_by)
    if sort_by:
        rows = rows.sortWithinPartitions(version_col, then_by, *sort_by)
    (
        rows.write.mode("overwrite")
        .options(partitionOverwriteMode="dynamic", **WRITTEN)
        .partitionBy(version_col, then_by)
        .parquet(location)
    )
    for version in versions:
        _mark_complete(spark, f"{location}/{version_col}={version}")
    standing_versions(spark, table, versions, then_by, version_col)


def standing_versions(
    spark: SparkSession, table: str, versions: Sequence[int], then_by: str, version_col: str = VERSION
) -> list[int]:
    """Those of ``versions`` that were written to their end; the catalog then knows their partitions, too."""
    location, standing, specs = location_of(spark, table), [], []
    for start in range(0, len(versions), _AT_ONCE):
        some = ",".join(str(v) for v in versions[start : start + _AT_ONCE])
        fs, hadoop_path = _hadoop(spark, f"{location}/{version_col}={{{some}}}/_SUCCESS")
        standing += [int(s.getPath().getParent().getName().split("=", 1)[1]) for s in fs.globStatus(hadoop_path) or []]
    for version, values in values_of_versions(spark, location, standing, then_by, version_col).items():
        specs += [f"PARTITION ({version_col} = {version}, {then_by} = '{value}')" for value in values]
    _add_partitions(spark, table, specs)
    if specs:
        spark.catalog.refreshTable(table)
    return sorted(standing)


def _in_table_shape(
    spark: SparkSession, table: str, rows: DataFrame, without: Sequence[str] = ()
) -> DataFrame:
    """The table's columns in the table's types (a bad cast is an error, as on INSERT)."""
    fields = [f for f in spark.table(table).schema.fields if f.name not in without]
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in fields])


def publish_snapshot(
    spark: SparkSession,
    table: str,
    rows: DataFrame,
    version: int,
    sort_by: Sequence[str] = (),
    not_null: Sequence[str] = (),
    sliced: bool = False,
) -> None:
    """Make ``rows`` the contents of ``table``; the previous version stays on disk.

    Of a ``sliced`` table they become the contents of the slices they belong to, and must be all
    rows of those; the other slices are neither read nor moved.

    Nulls in ``not_null`` columns are counted by the job that writes; any of them keeps the
    previous version in place and raises.
    """
    described = _described(spark, table)
    base = described["Location"].rsplit("/", 1)[0]
    path = f"{base}/v{version}"
    if sliced:
        rows = rows.withColumn(SLICE, _slice_number(spark, table, described))
        # A version that was written to its end may be in place in part already.
        if path_exists(spark, f"{path}/_SUCCESS"):
            return _place_slices(spark, table, base, version)
    rows = _in_table_shape(spark, table, rows)
    missing = Observation()
    if not_null:
        rows = rows.observe(missing, *[F.count_if(F.col(c).isNull()).alias(c) for c in not_null])
    if "Num Buckets" in described:
        _write_bucketed(spark, table, rows, path, described, by=[SLICE] if sliced else [])
    else:
        if sort_by:
            rows = rows.sortWithinPartitions(*sort_by)
        rows.write.mode("overwrite").options(**WRITTEN).parquet(path)
    if not_null:
        for column, count in missing.get.items():
            if count:
                _hadoop(spark, path)[0].delete(_hadoop(spark, path)[1], True)
                raise NotNullViolated(table, column, count)
    if sliced:
        return _place_slices(spark, table, base, version)
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
    _drop_older(spark, f"{base}/v*", version_in(described["Location"]))


def _write_bucketed(
    spark: SparkSession, table: str, rows: DataFrame, path: str, described: dict[str, str], by: Sequence[str]
) -> None:
    """Write files in the table's buckets; only tables can be bucketed, so one stands in."""
    stand_in = f"{table}__next"
    keys = _bucket_columns(described)
    spark.sql(f"DROP TABLE IF EXISTS {stand_in}")
    (
        rows.write.mode("overwrite")
        .partitionBy(*by)
        .bucketBy(int(described["Num Buckets"]), *keys)
        .sortBy(*keys)
        .options(path=path, **WRITTEN)
        .format("parquet")
        .saveAsTable(stand_in)
    )
    # External, so the files stay.
    spark.sql(f"DROP TABLE {stand_in}")


def _place_slices(spark: SparkSession, table: str, base: str, version: int) -> None:
    """Move the slices a version wrote to its folder, then note that it is in place.

    Every step may be repeated.  Two versions of a slice stay on disk; folders that hold no slice
    any more go, so that one listing of the folders stays as short as the table has slices.
    """
    fs, pattern = _hadoop(spark, f"{base}/v*/{SLICE}=*")
    folders: dict[str, dict[int, object]] = {}
    for status in fs.globStatus(pattern) or []:
        path = status.getPath()
        number = path.getName().split("=", 1)[1]
        folders.setdefault(number, {})[version_in(path.toString())] = path
    written = sorted((k for k, versions in folders.items() if version in versions), key=int)
    spec = f"PARTITION ({SLICE} = {{}}) LOCATION '{base}/v{version}/{SLICE}={{}}'"
    _add_partitions(spark, table, [spec.format(k, k) for k in written])
    for k in written:
        if len(folders[k]) > 1:
            spark.sql(f"ALTER TABLE {table} PARTITION ({SLICE} = {k}) SET LOCATION '{base}/v{version}/{SLICE}={k}'")
    spark.catalog.refreshTable(table)
    _touch(spark, f"{base}/_published_{version}")
    for older, mark in _published(spark, base):
        if older < version:
            fs.delete(mark, False)
    left = {path.getParent() for k in written for v, path in folders[k].items() if v < version}
    for k in written:
        for older in sorted(v for v in folders[k] if v < version)[:-1]:
            fs.delete(folders[k][older], True)
    for folder in left:
        if not _values_below(spark, folder.toString(), SLICE):
            fs.delete(folder, True)


def publish_partitions(
    spark: SparkSession,
    table: str,
    rows: DataFrame,
    version: int,
    partition: str,
    values: Sequence[str],
    sort_by: Sequence[str] = (),
) -> None:
    """Make ``rows`` the contents of the listed partitions; others are neither read nor moved."""
    base = location_of(spark, table).rsplit("/", 1)[0]
    rows = _in_table_shape(spark, table, rows).hint("rebalance", partition)
    if sort_by:
        rows = rows.sortWithinPartitions(partition, *sort_by)
    # Dynamic: a retry must not wipe partitions of this version that are already in place.
    (
        rows.write.mode("overwrite")
        .options(partitionOverwriteMode="dynamic", **WRITTEN)
        .partitionBy(partition)
        .parquet(f"{base}/v{version}")
    )
    _mark_complete(spark, f"{base}/v{version}")
    before = partition_versions(spark, table, partition, values)
    for value in values:
        path = f"{base}/v{version}/{partition}={value}"
        if value in before:
            spark.sql(
                f"ALTER TABLE {table} PARTITION ({partition} = '{value}') SET LOCATION '{path}'"
            )
            _drop_older(spark, f"{base}/v*/{partition}={value}", before[value])
        elif path_exists(spark, path):
            _add_partitions(spark, table, [f"PARTITION ({partition} = '{value}') LOCATION '{path}'"])
    spark.catalog.refreshTable(table)


# Files --------------------------------------------------------------------------------------


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def _mark_complete(spark: SparkSession, folder: str) -> None:
    """Jobs leave this mark themselves, but for dynamic overwrites."""
    _touch(spark, f"{folder}/_SUCCESS")


def _touch(spark: SparkSession, path: str) -> None:
    fs, mark = _hadoop(spark, path)
    fs.create(mark, True).close()


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _hadoop(spark, path)
    return fs.exists(hadoop_path)


def any_path(spark: SparkSession, pattern: str) -> bool:
    """Is there a file or folder of this glob pattern?  (Streams purge all but their last commits.)"""
    fs, hadoop_path = _hadoop(spark, pattern)
    return len(fs.globStatus(hadoop_path) or []) > 0


def _values_below(spark: SparkSession, path: str, name: str) -> list[str]:
    """Values of the partition directories ``name=value`` directly under ``path``."""
    fs, hadoop_path = _hadoop(spark, f"{path}/{name}=*")
    found = [s.getPath().getName() for s in fs.globStatus(hadoop_path) or []]
    return sorted(f.split("=", 1)[1] for f in found)


def _drop_older(spark: SparkSession, pattern: str, keep_from: int) -> None:
    """Delete the directories of versions before ``keep_from``: two versions stay readable."""
    fs, hadoop_path = _hadoop(spark, pattern)
    for status in fs.globStatus(hadoop_path) or []:
        version = version_in(status.getPath().toString())
        if 0 <= version < keep_from:
            fs.delete(status.getPath(), True)
