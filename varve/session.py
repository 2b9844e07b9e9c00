"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Dates and stamps are compared across engines and runs, so the zone is pinned.
    "spark.sql.session.timeZone": "UTC",
    # Row groups keep the range of these stamps, not that of the default type.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # Dirty text is handled with try_* functions, never by switching ANSI off.
    "spark.sql.ansi.enabled": "true",
    # AQE picks broadcast joins from measured sizes, splits skewed join partitions,
    # and evens out the REBALANCE shuffles in front of table writes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def build_session(
    app: str = "varve",
    master: str | None = None,
    extra: dict[str, str] | None = None,
    hive: bool = False,
) -> SparkSession:
    """A session with the settings above; ``hive=True`` keeps the catalog across sessions."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if hive:
        builder = builder.enableHiveSupport()
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
