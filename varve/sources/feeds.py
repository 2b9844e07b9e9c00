"""The three landing feeds and how to read them, as a batch or as a stream."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve import schemas


@dataclass(frozen=True)
class Feed:
    name: str
    table: str
    format: str
    schema: str
    options: dict[str, str] = field(default_factory=dict)
    # Bronze batches are laid out in ranges of this column; their time is their partition.
    key: str | None = None


CUSTOMERS = Feed("customers", "customers_bz", "csv", schemas.CUSTOMERS_FEED, {"header": "true"}, "customer_id")
# Whole-document JSON cannot be split: one file is one task, so land many files.
PRODUCTS = Feed("products", "products_bz", "json", schemas.PRODUCTS_FEED, {"multiLine": "true"}, "product_id")
TRANSACTIONS = Feed("transactions", "transactions_bz", "json", schemas.TRANSACTIONS_FEED)
FEEDS = (CUSTOMERS, PRODUCTS, TRANSACTIONS)


def stamped(df: DataFrame) -> DataFrame:
    """Add the ingest time (one value per batch) and the age of the source file."""
    return df.select(
        "*",
        F.current_timestamp().alias("inserted_time"),
        F.col("_metadata.file_modification_time").alias("source_modified"),
    )


def read_feed(spark: SparkSession, feed: Feed, path: str) -> DataFrame:
    """Fixed schema, no inference; cells that do not parse become null, the row stays."""
    reader = spark.read.format(feed.format).schema(feed.schema).options(**feed.options)
    return stamped(reader.load(path))


def stream_feed(
    spark: SparkSession,
    feed: Feed,
    path: str,
    archive: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """The feed as a file stream; consumed files move to ``archive`` one batch later."""
    reader = spark.readStream.format(feed.format).schema(feed.schema).options(**feed.options)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return stamped(reader.load(path))


def archived_files(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length of the archived files below ``path``, at any depth; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "modificationTime", "length")


def read_archive(spark: SparkSession, feed: Feed, path: str) -> DataFrame:
    """The rows of a feed's archived files, each with its ``source_file`` and ``source_length``."""
    reader = spark.read.format(feed.format).schema(feed.schema).options(**feed.options)
    return reader.option("recursiveFileLookup", "true").load(path).select(
        "*",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_size").alias("source_length"),
    )
