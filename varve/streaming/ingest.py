"""Files to bronze, each file exactly once.

The stream's checkpoint records which files belong to which batch, and a batch writes the
partition of its own number, so neither a crash nor a file that arrives meanwhile can lose
or repeat a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varve.errors import CheckpointLost, TableLost
from varve.sources.feeds import Feed, read_feed, stream_feed
from varve.sources.tables import BATCH, Settings, any_path, append_version, partition_values, path_exists


def land_batch(table: str, batch: DataFrame, batch_id: int, key: str | None = None) -> None:
    """Write one batch as its bronze partition (also the ``foreachBatch`` body).

    With a ``key`` the files of the partition hold ranges of it, in order.
    """
    append_version(batch.sparkSession, table, batch, batch_id, version_col=BATCH, ranges_of=key)


def ingest(
    spark: SparkSession,
    feed: Feed,
    settings: Settings,
    stream: bool = True,
    max_files: int | None = None,
) -> None:
    """Bring everything that has landed into bronze, then stop.

    ``stream=False`` reads the directory once as the next batch, for one-off loads: it keeps
    no record of consumed files.
    """
    table = settings.table("bronze", feed.table)
    path = settings.landing_path(feed.name)
    if not stream:
        done = [int(b) for b in partition_values(spark, table, BATCH)]
        land_batch(table, read_feed(spark, feed, path), max(done, default=-1) + 1, feed.key)
        return

    checkpoint = settings.checkpoint_path(feed.name)
    if partition_values(spark, table, BATCH) and not path_exists(spark, f"{checkpoint}/offsets"):
        raise CheckpointLost(table, checkpoint)
    if not partition_values(spark, table, BATCH) and any_path(spark, f"{checkpoint}/commits/[0-9]*"):
        raise TableLost(table, checkpoint)
    rows = stream_feed(spark, feed, path, settings.archive_path(feed.name), max_files)
    query = (
        rows.writeStream.queryName(f"{table} ingest")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: land_batch(table, batch, batch_id, feed.key))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
